import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tesselink.llm import chat

nasty = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "a", "é", "<|"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(nasty)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat._unrole(chat._role(text)) == text and "\n" not in chat._role(text)


def conversations(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(30)]:
        opens = rng.random() < 0.4
        for t in range(rng.choice([1, 2, 5, 60])):
            role = "system" if opens and t == 0 else rng.choice(["user", "assistant", None, "tool\nx\\n"])
            text = rng.choice([None, "", "hi <|im_end|>\n<|im_start|>assistant\nok", "word " * rng.randint(1, 400), "<\\| \\n é😀"])
            rows.append((c, t, role, text, "extra"))
    return rows


def want(rows):
    out = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n, turns, loss = out.get(c, (0, "", ""))
        out[c] = (n + 1, turns + f"{role or ''}\n{text or ''}\n", loss + (text or "") * (role == "assistant"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(t), len(x), sha(x)) for c, (n, t, x) in out.items()}


def test_read_back(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string").repartition(5)
    for budget, history in ((512, 2), (60, 0), (1, 3), (100000, 5)):
        windows = chat.format_windows(turns, budget=budget, history=history)
        got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
        assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want(rows)
        length = {}
        for w in windows.collect():
            assert w["n_tokens"] <= budget or w["n_new"] == 1
            parsed = chat.parse(w["text"])
            assert len(parsed) == w["repeated"] + w["n_new"] and w["repeated"] <= history + 1
            assert [chat.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"]] == [t for r, t in parsed[w["repeated"] :] if r == "assistant"]
            length[w["conv_id"]] = length.get(w["conv_id"], 0) + len(w["text"])
        assert {c: r["formatted_chars"] for c, r in got.items()} == length


def test_system_turn_is_kept(spark):
    rows = [(1, 0, "system", "be brief", "")] + [(1, k, ("user", "assistant")[k % 2 == 0], "word " * 20, "") for k in range(1, 20)]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x string"), budget=100).collect()
    assert len(windows) > 2
    for w in windows:
        assert chat.parse(w["text"])[0] == ("system", "be brief")


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_windows(turns)).count() == 0
