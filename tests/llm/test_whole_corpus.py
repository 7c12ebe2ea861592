"""Corpus operators do all steps on all rows."""

import collections
import random

from tidewire.llm import chat, decontaminate, queries

MESSAGES = "conv_id long, turn long, role string, text string"


def test_conversations_are_a_query(spark, tmp_path):
    rows = [(1, 0, "user", "First question of all."), (1, 1, "user", "Second question of all."), (1, 2, "assistant", "> First question of all.\nAn answer."), (1, 300, "assistant", "> Second question of all.\nLate."), (2, 0, "user", None)]
    spark.createDataFrame(rows, MESSAGES).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.queries()["op8_chat_conversations"](spark, str(tmp_path)).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id, r.part)):
        found[r.conv_id] += [(m.role, m.content) for m in r.messages]
    assert found == {1: [("user", rows[0][3]), ("assistant", "An answer."), ("user", rows[1][3]), ("assistant", "Late.")], 2: [("user", "")]}


def test_short_quotes_are_linked(spark):
    rows = [(1, 0, "user", "Yes."), (1, 1, "user", "好的"), (1, 2, "user", "Other words here."), (1, 3, "assistant", "> Yes.\nFine"), (1, 4, "assistant", ">好的\n>\n"), (1, 5, "user", ">\n> \nnothing quoted")]
    got = {r.turn: (r.parent_turn, r.thread_root, r.n_quoted, r.n_linked) for r in chat.replies(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got[3] == (0, 0, 1, 1) and got[4] == (1, 1, 1, 1) and got[5] == (None, 5, 0, 0)


def test_copies_in_other_case_are_found(spark):
    item = "A train leaves the old station of the city at 9 in the morning, Anna Miller rides 120 km with it and 120 again"
    named = "so we said that Anna Miller and Peter Smith and Mary Jones will ride"
    bench = spark.createDataFrame([(1, item), (2, named)], "item_id long, text string")
    texts = [item.title(), item.upper(), item.lower(), named.title(), named.lower(), "Nothing Of The Kind Is In Here At All Today 9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched == r.n_windows, r.same_values) for r in decontaminate.contaminated(rows, bench).collect()}
    assert got == {(i, 1 + (i > 2)): (True, True) for i in range(5)}


def test_conversations_equal_brute_force_in_bounded_parts(spark):
    """Ties, repeated rows and turns, nulls, and turns beyond one block, against an order made from the links of each message."""
    rng = random.Random(30)
    rows = [(c, t, rng.choice(["user", None]), (f"> Words {rng.randrange(t)} of {c}.\n" if t and rng.random() < 0.6 else "") + f"Words {t} of {c}.") for c in range(3) for t in [*range(40), *range(250, 270)]]
    rows += [(1, 5, "user", f"copy {i % 300}") for i in range(900)] + [(None, 3, "user", f"lost {i}") for i in range(50)] + [(2, None, "user", None)] * 20
    d = spark.createDataFrame(rows, MESSAGES).repartition(5)
    got = collections.defaultdict(list)
    for r in chat.conversations(d).collect():
        assert len(r.messages) <= chat.BLOCK
        if r.conv_id is None or r.part.turn is None:
            assert len(r.messages) == 1
        got[r.conv_id].append((r.part, [(m.role, m.content) for m in r.messages]))
    links = collections.defaultdict(list)
    for r in chat.replies(d).collect():
        links[r.conv_id].append(r)
    none = lambda x: (x is not None, x)  # noqa: E731  nulls come first
    for conv, parts in got.items():
        have = [m for part, messages in sorted((p for p in parts if p[0].turn is not None), key=lambda p: p[0]) for m in messages]
        known = [r for r in links[conv] if conv is not None and r.turn is not None]
        known.sort(key=lambda r: (r.thread_root // 256, r.turn // 256, r.thread_root, r.turn, none(r.role), none(r.content)))
        assert have == [(r.role, r.content) for r in known]
        rest = sorted((m for part, messages in parts if part.turn is None for m in messages), key=repr)
        assert rest == sorted(((r.role, r.content) for r in links[conv] if conv is None or r.turn is None), key=repr)
    assert sum(len(m) for parts in got.values() for _, m in parts) == len(rows)
