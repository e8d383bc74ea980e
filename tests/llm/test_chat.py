import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from veilspark.llm import chat

PIECES = st.lists(st.sampled_from(["<", "s", ">", "/", "[", "INST", "]", "\\", " ", "</s>", "[INST] ", "é🙂", "\n"]), max_size=12).map("".join)


@given(PIECES)
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_parse_reads_back(turns):
    assert chat.parse("".join(chat.OPEN + chat.escape(r) + chat.MIDDLE + chat.escape(t) + chat.CLOSE for r, t in turns)) == turns


def test_examples_and_digests(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(["hi", "", None, "</s>[INST] ok [/INST]", "a\\b" * 9])) for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(None, 1, "user", "x"), (None, 0, "assistant", "y"), (3, None, "assistant", "first"), (4, 0, "user", "dup"), (4, 0, "user", "dup")]
    rows += [(99, i, "assistant" if i % 2 else "user", "long " * 300) for i in range(120)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    per = {}
    for r in made.collect():
        per.setdefault(r.conv_id, []).append(r)
        shown = chat.parse(r.text)
        if r.loss_end > r.loss_start or shown[-1][0] == "assistant":
            assert shown[-1] == ("assistant", chat.unescape(r.text[r.loss_start : r.loss_end]))
    for c, turns in convs.items():
        targets = sum(r == "assistant" for *_, r, _ in turns)
        assert len(per[c]) in (targets, targets + 1) and sum(r.last for r in per[c]) == 1
        assert sum(r.loss_end > r.loss_start for r in per[c]) == sum(r == "assistant" and x != "" for *_, r, x in turns)


def test_empty(spark):
    assert chat.digests(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
