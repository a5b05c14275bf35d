"""Alignment, collocations and mixing against brute force and SQL, with the odd cases of their contracts."""

import hashlib
import random
import timeit
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest

from tidemark.llm import alignment, collocations, mixing
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "Same text. " * 3, "Same text. " * 3, "日本語 🙂 " * 50, "x" * 3000, "it's  we'll\t\t x", "a<|endoftext|> b</s> <0x41>", "ﬁne ½ é", "word " * 20_000]
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long and repeated texts, with columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, 1, 2.0, "k") for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "no id. no id", "en", "s1", 1, 2.0, "k"), (None, "no id. no id", "en", "s1", 1, 2.0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, size double, key string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def sql(name, **frames):
    c = duckdb.connect()
    for n, f in frames.items():
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{f}'") if isinstance(f, str) else c.register(n, f)
    return c.sql(ORACLE_SQL[name]).df()


def same(got, want):
    def plain(df):
        return df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)

    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, check_exact=False, rtol=1e-12, atol=0)


def slow_alignment(docs):
    """Every pair of tokens looked at; other code for ids and bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte = alignment.byte_level_tokens(A)
    found, held = [], defaultdict(set)
    for k, (_, text) in enumerate(docs):
        text = text or ""
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        tokens_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
        tokens_a = [byte[i] for i in a]
        whole = (" " + text).encode()
        if not text or b"".join(tokens_a) != whole or b"".join(tokens_b) != whole:
            found.append(None)
            continue
        spans = [[], []]
        for side, tokens in enumerate((tokens_a, tokens_b)):
            at = 0
            for x in tokens:
                spans[side].append((at, at + len(x)))
                at += len(x)
        links, j0 = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, x, y = [], 0, 0
        for e in ends:
            i, j = x, y
            while x < len(a) and spans[0][x][1] <= e:
                x += 1
            while y < len(b) and spans[1][y][1] <= e:
                y += 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
        for pair in links:
            held[pair].add(k)
    most = Counter()
    for (a, _), docs_ in held.items():
        most[a] = max(most[a], len(docs_))
    out = []
    for (doc, _), f in zip(docs, found, strict=True):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            counts = [len(held[x]) for x in f[3]]
            best = sum(c == most[x[0]] for c, x in zip(counts, f[3], strict=True))
            out.append((doc, f[0], f[1], f[2], len(f[3]), best, sum(counts), hashlib.sha256(f[4].encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_alignment_of_all_documents_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op11_cross_tokenizer_alignment"](spark, SF)) == slow_alignment(docs)


def test_alignment_odd_texts_in_many_shards(odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = slow_alignment(docs)
    for links in (10, 6_000_000):
        assert rows_of(alignment.align_documents(odd, A, B, shard_links=links)) == want
    assert any(r[4] > r[1] for r in want) and any(not r[1] and d for r, d in zip(want, docs, strict=False))
    assert rows_of(alignment.align_documents(none, A, B)) == []


def test_elementary_intervals_are_the_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(50):
        end = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, rng.integers(0, end)), end)) for _ in range(2))
        ends, own_a, own_b = alignment.overlaps(a, b)
        spans_a, spans_b = (list(zip([0, *x[:-1]], x, strict=True)) for x in (a, b))
        want = [(i, j) for i, (s, e) in enumerate(spans_a) for j, (t, f) in enumerate(spans_b) if max(s, t) < min(e, f)]
        assert list(zip(own_a.tolist(), own_b.tolist(), strict=True)) == want and ends[-1] == end


def test_intervals_cost_less_than_sorting_their_ends():
    rng = np.random.default_rng(5)
    a, b = (np.flatnonzero(np.append(rng.random(200_000) < 0.3, True)) + 1 for _ in range(2))

    def quickest(f):
        return min(timeit.repeat(lambda: f(a, b), number=10, repeat=7))

    assert quickest(alignment.overlaps) < quickest(lambda a, b: (np.union1d(a, b), np.searchsorted(a, b)))


def test_collocations_and_mixing_agree_with_sql(spark):
    for name in ("op12_phrase_collocations", "op13_source_mixing"):
        same(QUERIES[name](spark, SF).toPandas(), sql(name, documents=f"{SF}/documents.parquet"))


def test_collocations_of_odd_texts(spark, odd, none):
    want = sql("op12_phrase_collocations", documents=odd.select("text", "lang").toArrow())
    for positions in (40, 2_000_000):
        same(collocations.collocations(odd, shard_words=positions).toPandas(), want)
    assert {"en", "und"} >= set(want["lang"]) and len(want)
    assert collocations.collocations(none).count() == 0


def test_collocations_in_many_shards_against_counting(spark):
    """Whatever a shard's size, phrases are counted as a plain scan of the pieces does; pieces end where they should."""
    rng, words = random.Random(4), ["a", "b", "cc", "dd", "é", "f-f", "0"]
    texts = ["".join(rng.choice(words).upper() + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ";"]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    want: Counter = Counter()
    for text in texts:
        for piece in "".join("." if c in ".,;:!?\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in text).split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            for k in range(2, 5):
                want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    docs = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string").repartition(3)
    for positions in (25, 1000):
        _, known, phrases = collocations.phrase_counts(docs, least=5, shard_words=positions)
        spelt = {r["id"]: r["word"] for r in known.collect()}
        assert {tuple(spelt[i] for i in r["phrase"]): r["a"] for r in phrases.collect()} == {p: a for p, a in want.items() if a >= 5}


def test_collocations_first_rows_of_a_language(spark):
    docs = spark.createDataFrame([(" ".join(f"p{i} q{i}. " * (30 + i % 7) for i in range(40)), "en")], "text string, lang string")
    got = collocations.collocations(docs, most=25).toPandas().sort_values("rank")
    full = collocations.collocations(docs).toPandas().sort_values("rank")
    assert len(full) == 40 and got["phrase"].tolist() == full["phrase"].tolist()[:25] and got["rank"].tolist() == list(range(1, 26))


def slow_filling(sizes, weights, share, epochs):
    """Clamp and share anew until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, Fraction(share[0] * sum(sizes.values()), share[1]), set(order)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > epochs * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = Fraction(epochs * sizes[s])
            left -= target[s]
        free -= over


def test_water_filling_against_rounds(spark):
    rng = random.Random(6)
    for n, weights, share, epochs in ((1, (3, 1, 2), (3, 2), 2), (7, (3, 1, 2), (3, 2), 2), (40, (5, 1), (2, 1), 2), (40, (1, 9, 2, 2), (5, 2), 4), (12, (1,), (1, 3), 1)):
        sizes = {f"s{i}" if i else None: rng.choice([0, 1, 5, 50, 1000, 12345]) for i in range(n)}
        got = mixing.water_filling(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), weights, share, epochs).collect()
        want = slow_filling(sizes, weights, share, epochs)
        assert {r["source"]: pytest.approx(r["target"], rel=1e-12) for r in got} == {s: float(t) for s, t in want.items()}
    with pytest.raises(ValueError):
        mixing.water_filling(spark.createDataFrame([("a", 1)], "source string, source_size long"), (1,), (3, 1), 2)


def test_mixing_odd_texts(spark, odd, none):
    got = mixing.mix_documents(odd)
    same(got.select("doc_id", "size", "source_size", "target", "taken").toPandas(), sql("op13_source_mixing", documents=odd.select("doc_id", "text", "source").toArrow()))
    assert mixing.mix_documents(none).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_documents(empty).collect()] == [(0, 0.0, 0)] * 2


def test_mixing_takes_what_it_says(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 23 as int)) as text", "concat('s', cast(least(id % 9, 4) as string)) as source")
    mix = mixing.mix_documents(docs)
    rows = mix.toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 12).all() and (by["target"] <= 2 * by["size"]).all()
    assert by["target"].sum() == pytest.approx(1.5 * by["size"].sum())
    copies = mixing.mixed_texts(docs, mix).toPandas()
    assert copies.groupby("doc_id").size().to_dict() == {k: v for k, v in zip(rows["doc_id"], rows["repeats"], strict=True) if v}
    again = mixing.mix_documents(docs.repartition(7)).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == rows.sort_values("doc_id")["taken"].tolist()


def test_mixing_by_a_shuffle_when_sources_are_many(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('w ', cast(id % 5 as int)) as text", "cast(id % 300 as string) as source")
    want = mixing.mix_documents(docs).toPandas().sort_values("doc_id")["taken"].tolist()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert mixing.mix_documents(docs).toPandas().sort_values("doc_id")["taken"].tolist() == want


def test_mixing_runs_no_python(spark):
    rows = mixing.measured(spark.read.parquet(f"{SF}/documents.parquet"), 13)
    plan = mixing.repetitions(rows, mixing.mixture_plan(rows))
    assert not any(w in plan._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))
