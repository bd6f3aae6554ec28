import hashlib
import random
from collections import defaultdict

import pytest

from flowsieve.llm import chat as C


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        everything = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((str(c), len(turns), digest(everything), len(loss), digest(loss)))
    return sorted(out)


def got(df):
    return sorted((str(r["conv"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect())


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_round_trip_of_control_strings(spark):
    rng = random.Random(1)
    parts = ["### ", "\\", "</turn>", " </turn>\n", "Assistant: ", "a", "\n", "😀", "\x1a", ": ", "#", "%3A", ""]
    rows = list(C.PROBE)
    for c in range(60):
        for k in range(rng.randrange(1, 9)):
            text = rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))])
            role = rng.choice(["user", "assistant", "system", None, "a: b", "### x%3A", "</turn>"])
            rows.append((rng.choice([c, None]), rng.choice([k, None, 0]), role, text))
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(C.read_back(C.format_conversations(df))) == brute(rows)


def test_real_table_and_none(spark, tables):
    turns = tables("conversations")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    back = C.read_back(C.format_conversations(turns))
    assert got(back) == brute(rows)
    assert back.where("rewrote").count() == 0
    assert C.read_back(C.format_conversations(turns.where("false"))).count() == 0


def test_other_templates_are_black_boxes():
    turns = [("user", "hi"), ("assistant", "yes hi"), ("user", "x"), ("assistant", "")]

    def bos(t):  # something before the first turn, and a reminder of the turn before
        return "<s>" + "".join(f"[{r}|{len(p[1])}]{x};" for (r, x), p in zip(t, [("", "")] + t))

    found = list(C.rendered(turns, bos, None))
    assert "".join(["<s>"] + [s for s, *_ in found]) == bos(turns) or "".join(s for s, *_ in found) == bos(turns)[3:]
    assert [s[a:b] for s, a, b, _ in found] == [x for _, x in turns]
    assert not any(r for *_, r in found)
    assert list(C.rendered(turns, bos, 1)) == found

    def last_only(t):  # leaves older answers out
        return "".join(f"[{r}]{x if k == len(t) - 1 or r == 'user' else '...'};" for k, (r, x) in enumerate(t))

    assert [r for *_, r in C.rendered(turns, last_only, None)] == [False, False, True, False]


@pytest.mark.parametrize("history", [0, 1, 4, None])
def test_history_does_not_matter_to_a_template_of_single_turns(history):
    turns = [("user", f"t{k}") for k in range(30)]
    assert "".join(s for s, *_ in C.rendered(turns, C.plain_template, history)) == C.plain_template(turns)


def test_whole_prefixes_by_default(spark):
    def late(t):  # from the eighth turn on, the first one is folded away
        return "".join(f"[{r}]{'' if k == 0 and len(t) > 7 else x};" for k, (r, x) in enumerate(t))

    rows = [(1, k, "user", f"t{k}") for k in range(10)]
    made = C.format_conversations(spark.createDataFrame(rows, SCHEMA), template=late)
    assert [r["seq"] for r in made.where("rewrote").collect()] == [7]


def test_two_renderings_a_turn():
    """The last rendering is kept; without a bound a turn costs its own prefix and the one with the sentinel."""
    calls = []

    def counted(t):
        calls.append(len(t))
        return C.plain_template(t)

    turns = [("user", f"t{k}") for k in range(12)]
    whole = list(C.rendered(turns, counted, None))
    assert len(calls) == 1 + 2 * 12
    for history in range(14):
        assert list(C.rendered(turns, C.plain_template, history)) == whole


def test_other_columns_do_not_matter(spark):
    """Extra columns with names that the operator uses itself, in other case too."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ["conv", "Seq", "segment", "LOSS_START", "loss_end", "rewrote", "n_turns"]:
        df = df.withColumn(name, df.turn)
    assert got(C.read_back(C.format_conversations(df))) == brute(rows)
