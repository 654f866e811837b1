import json

from tessera.streaming.guards import AnswerText


def read(pieces):
    scan = AnswerText((1,))
    return [r[2] for n, p in enumerate(pieces) for r in scan.take(n, p)]


def test_only_the_answer_gets_out():
    text = 'Say "hi"\n\ttab \\ back é 世 end'
    whole = json.dumps({"thought": "secret", "action": "answer", "action_input": text}) + ' {"tail": "no"}'
    for size in (1, 2, 3, 5, 7, 1000):
        assert "".join(read([whole[k : k + size] for k in range(0, len(whole), size)])) == text
    other = json.dumps({"thought": "x", "action": "search", "action_input": text})
    assert read([other]) == [] and read(['{"action": "finish", "action_input": "ab', "cd"]) == ["ab", "cd"]


def test_surrogates_and_bad_escapes():
    text = "emoji \U0001f600 and \U0001f1e9\U0001f1ea, end"
    whole = json.dumps({"action": "answer", "action_input": text})
    assert "\\ud83d" in whole
    for size in (1, 2, 3, 5, 7, 1000):
        assert "".join(read([whole[k : k + size] for k in range(0, len(whole), size)])) == text
    for raw, want in ((r"a\ud83d b", "a\ufffd b"), (r"a\ude00b", "a\ufffdb"), (r"\ud83d\u0041", "\ufffdA"), (r"\uzz12 x", r"\uzz12 x"), (r"x\q", r"x\q"), (r"\ud83d", "\ufffd"), (r"\u12", r"\u12"), (r"\/\"", '/"')):
        for size in (1, 3, 1000):
            whole = '{"action":"finish","action_input":"' + raw + '"} tail'
            assert "".join(read([whole[k : k + size] for k in range(0, len(whole), size)])) == want, raw


def test_order_of_keys_and_long_heads():
    assert "".join(read(['{"action_input": "fir', 'st", "action": "ans', 'wer"}'])) == "first"
    head = '{"thought": "' + "x" * 300_000 + '", "action": "answer", "action_input": "ok"}'
    assert "".join(read([head[k : k + 7] for k in range(0, len(head), 7)])) == "ok"
