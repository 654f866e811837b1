"""Queries over sections, fragments and cleaned texts with their places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import offsets as O
from ..operators import sections as S
from .registry import query

_LINES = """s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
l AS (SELECT doc_id, pos, trim(CASE WHEN pos % 7 = 3 THEN '2. 《' || substr(raw, 1, 10) || '》JGJ 120-2012' WHEN pos % 4 = 0 THEN (pos // 4 + 1) || '. ' || raw ELSE 'x ' || raw END) AS line FROM s)"""


@query("section_scope", rf"""WITH {_LINES}, h AS (SELECT *, regexp_matches(line, '^\s*(第?[一二三四五六七八九十]+[、.．]|[0-9]+([.．][0-9]+)*\s*[、.．]?)\s*\S') AND NOT regexp_matches(line, '[《》“”(（]|[A-Z]{{2,}}\s*[0-9]') AS is_head FROM l),
w AS (SELECT *, last_value(CASE WHEN is_head THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS head FROM h),
g AS (SELECT doc_id, count(*) FILTER (WHERE is_head) AS heads, list_sort(list_distinct(list(line) FILTER (WHERE (contains(head, 'the') OR contains(head, 'der')) AND line <> ''))) AS scope FROM w GROUP BY 1)
SELECT doc_id, heads, CASE WHEN len(scope) > 0 THEN len(scope) END AS n_scope, CASE WHEN len(scope) > 0 THEN md5(array_to_string(scope, chr(10))) END AS digest FROM g""")
def section_scope(t, spark):
    """Lines as sections: every fourth numbered, every seventh a cited standard, which heads nothing."""
    raw, pos = F.col("raw"), F.col("pos")
    line = F.when(pos % 7 == 3, F.concat(F.lit("2. 《"), F.substring("raw", 1, 10), F.lit("》JGJ 120-2012"))).when(pos % 4 == 0, F.concat(F.floor(pos / 4 + 1).cast("string"), F.lit(". "), raw)).otherwise(F.concat(F.lit("x "), raw))
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", "pos", F.trim(line).alias("line"))
    out = S.section_scope(lines, ["the", "der"])
    return out.select("doc_id", "heads", F.when(F.col("scope").isNotNull(), F.size("scope")).cast("long").alias("n_scope"), F.md5(F.array_join("scope", "\n")).alias("digest"))


@query("fragment_slices")
def fragment_slices(t, spark):
    """Fragments around lines with long words, six such lines each, short ones joined."""
    found = F.posexplode(S.fragments(F.col("text"), "[a-z]{9,}"))
    return t("documents").select("doc_id", found.alias("place", "f")).select("doc_id", "place", "f.n", F.col("f.body").alias("text"))


@query("cleaned_texts")
def cleaned_texts(t, spark):
    """The whole cleaning chain, with the place of each character that is left."""
    return O.cleaned(t("documents")).select("doc_id", "clean", "offsets")


@query("marked_terms")
def marked_terms(t, spark):
    """Terms found in the cleaned text, marked where they stand in the text as it was."""
    found = O.cleaned(t("documents"), "[A-Z][a-z]{5,}").select("doc_id", "spans")
    j = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found, "doc_id")
    return j.select("doc_id", F.size("spans").alias("n"), O.marked(F.col("text"), F.col("spans"), "[[", "]]").alias("text"))
