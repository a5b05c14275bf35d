import random
import re
from itertools import accumulate

import xxhash

from tidemark.llm.line_dedup import _running_sums, dedup_lines, stage


def version(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def brute(rows, min_chars=120):
    """From the definition: lines of any run of ``min_chars`` or more (text and one for each line) that is seen earlier go."""
    cut = {r: [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", r[1]) if x] for r in rows if r[0] is not None and r[1]}
    same = {r: [x.strip(" \t\r\n") for x in lines] for r, lines in cut.items()}
    order = {r: (r[0], version(r[1])) for r in cut}
    out = {}
    for r, own in same.items():
        gone = set()
        for e, other in same.items():
            for q in range(len(other) if order[e] <= order[r] else 0):
                for p in range(q + 1 if e == r else 0, len(own)):
                    k = 0
                    while p + k < len(own) and q + k < len(other) and own[p + k] == other[q + k]:
                        k += 1
                    if sum(len(x) + 1 for x in own[p : p + k]) >= min_chars:
                        gone |= set(range(p, p + k))
        out[r] = "".join(x for i, x in enumerate(cut[r]) if i not in gone)
    return sorted(((r[0], out.get(r, r[1])) for r in rows), key=str)


def line(rng, n=9):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def cut_by_spark(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(((r["doc_id"], r["text"]) for r in dedup_lines(df).collect()), key=str)


def test_every_repeat_goes_and_nothing_else(spark):
    rng = random.Random(6)
    long, pair = line(rng, 60) + "\n", [line(rng, 14) + ". ", line(rng, 14) + "\n"]
    mixed = [line(rng, 25) + ". ", "So it is. ", line(rng, 25) + "! "]
    tiny = [w + "\n" for w in line(rng, 40).split()]
    rows = [(0, "So it is. " + line(rng, 30))]
    for d in range(1, 45):
        parts = []
        for _ in range(rng.randint(0, 8)):
            parts += rng.choice([[line(rng) + "! "], [line(rng, 3) + "\n"], [long], pair, mixed, mixed[: rng.randint(1, 3)], tiny[rng.randint(0, 9) :], ["So it is. "], ["  " + long], ["\n"]])
        rows.append((d, "".join(parts) + rng.choice(["", line(rng, 2)])))
    rows += [(70, None), (71, ""), (None, "x\n" * 90), (72, "a\x01b. " + "".join(pair)), (73, (line(rng) + "\n") * 40), (74, ("x\n" * 3 + "y\n") * 50)]
    got = cut_by_spark(spark, rows)
    assert got == brute(rows)
    assert sum(len(t or "") for _, t in got) < 0.8 * sum(len(t or "") for _, t in rows)


def test_a_third_document_hides_no_repeat(spark):
    rng = random.Random(9)
    a, b, c = (line(rng, 8) + ". " for _ in range(3))
    rows = [(1, a), (2, b), (3, c), (4, line(rng, 20) + "\n" + a + b + c + line(rng)), (5, line(rng, 25) + "\n" + a + b + c + line(rng))]
    got = cut_by_spark(spark, rows)
    assert got == brute(rows) and len(dict(got)[5]) == len(dict(rows)[5]) - len(a + b + c) and dict(got)[4] == dict(rows)[4]


def test_rows_that_share_a_doc_id_are_apart(spark):
    rng = random.Random(10)
    passage = "".join(line(rng, 12) + ". " for _ in range(4))
    rows = [(0, passage), (1, line(rng, 20) + "\n" + passage), (1, line(rng, 200)), (2, "t " * 90 + "\n" + passage), (2, "t " * 90 + "\n" + passage)]
    got = cut_by_spark(spark, rows)
    assert got == brute(rows) and rows[2] in got and got.count((2, "t " * 90 + "\n")) == 2


def test_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(5)
    passage = ". ".join(line(rng, 9) for _ in range(7)) + "."
    rows = [(d, f"{line(rng, 40)} {passage} {line(rng, 40)}", 1) for d in range(30)] + [(100 + d, line(rng, 80), 2) for d in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed_chars int")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert all(got[d] == t for d, t, _ in rows if d >= 100 or d == 0)
    assert all(len(got[d]) < len(t) - 250 for d, t, _ in rows if 0 < d < 100)


def test_long_texts_of_many_short_lines(spark):
    rng = random.Random(11)
    words = [line(rng, 1) for _ in range(3000)]
    rows = [(1, "\n".join(words)), (2, "\n".join([*words[500:2500], *(line(rng, 1) for _ in range(100))]))]
    got = dict(cut_by_spark(spark, rows, 1))
    assert got[1] == rows[0][1] and len(got[2].split("\n")) <= 101


def test_stage_keeps_columns_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    out = stage(spark, df, "")
    assert out.columns == df.columns and out.count() == 0
    df = spark.createDataFrame([(1, "abc", "x", 9, "k", "v")], "doc_id long, text string, version string, n_chars long, key string, runs string")
    assert [tuple(r) for r in stage(spark, df, "").collect()] == [(1, "abc", "x", 3, "k", "v")]


def test_running_sums_across_blocks(spark):
    rng = random.Random(12)
    rows = [(n, [rng.randint(1, 2**20) for _ in range(n)]) for n in (1, 2, 31, 32, 33, 64, 1023, 1024, 1025, 33_000)]
    got = _running_sums(spark.createDataFrame(rows, "id long, m array<int>"), "m", "ends", ["id"]).collect()
    assert {r["id"]: r["ends"] for r in got} == {n: list(accumulate(m, initial=0)) for n, m in rows}


def test_tiny_lines_and_lines_of_just_the_share(spark):
    rng = random.Random(13)
    tiny = [rng.choice("abcdefgh") * rng.randint(1, 2) + "\n" for _ in range(300)]
    rows = [(1, "".join(tiny)), (2, "".join(tiny[20:97] + ["\n"] * 3 + tiny[100:260])), (3, "".join(tiny[250:])), (4, "\n" * 130)]
    rows += [(5, "x" * 119 + "\n"), (6, "x" * 119 + "\n"), (7, "y" * 118 + "\n"), (8, "y" * 118 + "\n"), (9, "y" * 118 + "\nz"), (10, "q\n" + "y" * 118 + "\nz\n")]
    assert cut_by_spark(spark, rows) == brute(rows)
