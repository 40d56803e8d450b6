import random

from tarnflow.llm import quotes
from tarnflow.llm.common import table  # noqa: F401
from tarnflow.llm.quotes import as_replies, link_quotes, passages

SCHEMA = "conv_id long, turn long, role string, text string, body string"


def _run(spark, rows):
    got = link_quotes(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)).collect()
    return {(r.conv_id, r.turn): r for r in got}, got


def test_passages():
    body, quoted = passages("On Monday A wrote:\n> one\n> two\n>> deep\n>\n> three\n\nmy answer\nmore")
    assert body == "\nmy answer\nmore".strip("\n")
    assert quoted == [(1, "one\ntwo"), (2, "deep"), (1, "three")]
    assert passages("no quote, 3 > 2") == ("no quote, 3 > 2", [])


def test_links_threads_order(spark):
    rows = [
        (1, 0, "user", "The first question is here.\n\nAnd a second paragraph."),
        (1, 1, "user", "Another topic altogether, nothing more."),
        (1, 2, "assistant", "> the FIRST   question\n> is here.\nAn answer to the first."),
        (1, 3, "assistant", "> Another topic altogether, nothing more.\nAn answer to the other."),
        (1, 4, "user", ">> The first question is here.\n> An answer to the first.\nThanks."),
        (1, 5, "user", "> never said anywhere\nWhat?"),
        (2, 0, "user", "> The first question is here.\nOther conversation."),
        (2, 1, "user", None),
        (2, 2, "user", ""),
        (None, 0, "user", "lost"),
        (3, None, "user", "no turn"),
    ]
    by, got = _run(spark, rows)
    assert len(got) == len(rows)
    assert by[1, 2].parent_turn == 0 and by[1, 3].parent_turn == 1 and by[1, 4].parent_turn == 2
    assert by[1, 4].depth == 2 and by[1, 4].thread_turn == 0 and by[1, 4].body == "Thanks." and by[1, 4].n_quotes == 2
    assert by[1, 5].parent_turn is None and by[1, 5].n_quotes == 1 and by[1, 5].n_linked == 0
    assert by[2, 0].parent_turn is None and by[2, 1].body is None and by[2, 2].body == ""
    assert [t for t, _ in sorted(((t, r.position) for (c, t), r in by.items() if c == 1), key=lambda x: x[1])] == [0, 2, 4, 1, 3, 5]
    assert by[None, 0].position == 0 and by[3, None].position == 0


def test_long_chain_and_repeats(spark):
    n = 1300
    rows = [(7, 0, "user", "message number 0 of the chain")]
    rows += [(7, t, "user", f"> message number {t - 1} of the chain\nmessage number {t} of the chain") for t in range(1, n)]
    rows += [(7, 5, "user", rows[5][3])]
    by, got = _run(spark, rows)
    assert sorted(r.position for r in got) == list(range(n + 1))
    assert by[7, n - 1].depth == n - 1 and by[7, n - 1].thread_turn == 0
    assert [r.turn for r in sorted(got, key=lambda r: r.position)] == sorted([*range(n), 5])


def test_nothing(spark):
    assert _run(spark, [])[1] == []


def test_rendered_replies_are_recovered(spark):
    """Every reply of a corpus written as quotes is linked to what it answers, by a plain reading of the same rule."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 9)):
            if (c, t) != (3, 2):  # a message is missing
                rows.append((c, t, "user", None if (c, t) == (4, 1) else "" if (c, t) == (5, 1) else "\n\n".join(prose(rng.randint(4, 12)) + ".\n" + prose(5) + "?" for _ in range(rng.randint(1, 3)))))
    rows += [(20, 0, "user", " ".join(prose(40_000).split()) + "."), (20, 1, "assistant", prose(9)), (20, 1, "assistant", prose(9)), (20, 2, "user", prose(6) + ".")]
    text = {}
    for c, t, _, x in rows:
        if (x or "").strip():
            text[c, t] = min(x, text.get((c, t), x))
    answered = {(c, t): t - 1 - ((c + t) % 3 == 0) for c, t, _, x in rows if x is not None}
    answered = {k: up if (k[0], up) in text else None for k, up in answered.items()}
    got = link_quotes(as_replies(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.parent_turn == answered.get((r.conv_id, r.turn)), (r.conv_id, r.turn)
        if r.parent_turn is not None:
            deeper = answered.get((r.conv_id, r.parent_turn))
            said = [text[r.conv_id, u] for u in (r.parent_turn, deeper) if u is not None]
            assert r.n_quotes == r.n_linked == sum(len(x.split("\n\n")) for x in said)
    assert sorted(str((r.conv_id, r.turn, r.body)) for r in got) == sorted(str((c, t, x)) for c, t, _, x in rows)


def test_short_sentences_and_parts_of_paragraphs(spark):
    rows = [
        (1, 0, "user", "See you Monday. Bring the long list of things we wrote down. 明日行く。本も買う。"),
        (1, 1, "user", "Something else is said in this message."),
        (1, 2, "user", "> See you Monday.\nFine."),
        (1, 3, "user", "> Bring the long list of things we wrote down.\n> See you Monday.\nYes."),
        (1, 4, "user", "> 本も買う。\n買うよ。"),
        (1, 5, "user", "> Fine.\n> Something else is said in this message.\nThat counts, not the short one."),
    ]
    by, _ = _run(spark, rows)
    assert [by[1, t].parent_turn for t in range(6)] == [None, None, 0, 0, 0, 1]


def test_one_turn_of_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SHARES", 4)
    rows = [(None, None, "user", f"lost {i % 30}") for i in range(90)] + [(1, 0, "user", f"first {i}") for i in range(40)] + [(1, 1, "user", "> first 3\nanswer")]
    _, got = _run(spark, rows)
    assert sorted(r.position for r in got if r.conv_id is None) == list(range(90))
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(41))
    assert [r.parent_turn for r in got if r.turn == 1] == [0]
