"""Operators 11 to 13 against the libraries and brute force, on small tables with odd rows."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from turnmill.llm import impact_topk, part_codes, queries, token_align

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "  a  b \n\n foo\nbar ", "a▁b", "<|endoftext|> <s> </s> <0x41>", "😀!é ̈ x\x00\t日本語", "ab" * 900, "一" * 300, "the the the", "the the the", "x" * 5000]


def by_key(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def brute_links(texts):
    """texts: (id, text). The contract of operator 11, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    al = token_align.Aligner(A, B)
    docs = []
    for i, t in texts:
        t = t or ""
        a, b = tok.encode(f" {t}", add_special_tokens=False).ids, sp.encode(t)
        bytes_a, bytes_b = [al.A.merges.vocabulary[x] for x in a], [al.B.bytes[x] for x in b]
        if not t or b"".join(bytes_a) != f" {t}".encode() or b"".join(bytes_b) != f" {t}".encode():
            docs.append((i, [], [], []))
            continue
        ends = lambda parts: np.cumsum([len(x) for x in parts]).tolist()
        at_a, at_b = ({e: k + 1 for k, e in enumerate(ends(x))} for x in (bytes_a, bytes_b))
        groups, p, q = [], 0, 0
        for e in sorted(at_a.keys() & at_b.keys()):
            groups.append((a[p : at_a[e]], b[q : at_b[e]]))
            p, q = at_a[e], at_b[e]
        docs.append((i, a, b, groups))
    held, best = Counter(), Counter()
    for _, _, _, groups in docs:
        held.update({(x, y) for g, h in groups for x in set(g) for y in set(h)})
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, groups in docs:
        links = Counter()
        for g, h in groups:
            for x, m in Counter(g).items():
                for y, n in Counter(h).items():
                    links[x, y] += m * n
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(a), len(b), len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_op11(spark):
    rows = [(900_000 + i, t) for i, t in enumerate(ODD)] + [(900_000, "the the the"), (None, "one two")]
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows + own], "doc_id long, text string, row int, pairs int")
    want = by_key(brute_links(rows + own))
    for hot in (token_align.HOT, 50):  # with 50, most pairs go through the join
        assert by_key(map(tuple, token_align.links(docs, A, B, hot).collect())) == want
    assert token_align.links(docs.limit(0), A, B).count() == 0
    spans = {r.doc_id: r for r in token_align.align(docs.filter("doc_id >= 900000"), A, B).collect()}
    r = spans[900_004]
    assert r.ends[-1] == len(f" {ODD[4]}".encode()) and r.upto_a[-1] == len(r.a_ids) and r.upto_b[-1] == len(r.b_ids) and spans[900_005].ends == []
    with pytest.raises(ValueError):
        token_align.Aligner(P.path("word_bpe_49k.json"), B)


def test_op11_large_groups_and_rows(monkeypatch):
    """Groups beyond SMALL and whole texts give the same pairs; the library's own cut isn't needed."""
    texts = [t for t in ODD if t] + ["zq" * 40 + " end"]
    al = token_align.Aligner(A, B)
    some, found = al.align(texts)
    want = [(d, p.tolist(), n.tolist()) for d, p, n in found.pairs(al.B.size)]
    monkeypatch.setattr(token_align, "SMALL", 1)
    assert [(d, p.tolist(), n.tolist()) for d, p, n in al.align(texts)[1].pairs(al.B.size)] == want
    al.B.runs = None
    assert (al.align(texts)[1].b == found.b).all()


def test_galloping():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 400), (300, 300), (1000, 1001)):
        long = np.sort(rng.choice(5000, m, replace=False))
        short = np.sort(np.append(rng.choice(long[-1], n - 1, replace=False), long[-1]))
        i, j = token_align.intersection(short, long, np.zeros(n, np.int64))
        assert short[i].tolist() == sorted(set(short.tolist()) & set(long.tolist())) and (long[j] == short[i]).all()


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, label int, row int, dim int")


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)) * 0.3
    rows = [(i if i % 97 else None, v.tolist(), int(i % 3) if i % 5 else None) for i, v in enumerate(x)]
    rows += [(7, x[7].tolist(), 1)] * 3 + [(650, x[0].tolist(), 0), (650, x[1].tolist(), 0), (700, None, 1), (701, [1.0, None] * 4, 1), (702, [math.nan] * 8, 2), (703, [math.inf] * 8, 2), (704, [0.0] * 8, 2)]
    return rows


def whole(rows, scale):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    return kept, [[math.floor(scale * c) for c in r[1]] for r in kept]


def test_op12(spark, some, monkeypatch):
    rows = [*some, (750, [1e200] * 8, 0), (800, [], 0), (801, [], 0), (850, [0.5] * 4, 0), (851, [0.25] * 4, 0), (900, [1.0], 0)]
    kept, x = whole(rows, 256)
    want = []
    for i, (q, _, _) in enumerate(kept):
        if q is not None and q % 50 == 0:
            clip = lambda s: max(-(2**63), min(2**63 - 1, s))
            scores = [(-clip(sum(a * b for a, b in zip(x[i], y))), r[0] is None, r[0] or 0) for j, (r, y) in enumerate(zip(kept, x)) if j != i and len(y) == len(x[i])]
            want += [(q, rank + 1, None if unnamed else v, -s) for rank, (s, unnamed, v) in enumerate(sorted(scores)[:5])]
    for part in (impact_topk.PART, 100):
        monkeypatch.setattr(impact_topk, "PART", part)
        assert by_key(map(tuple, impact_topk.search(vectors(spark, rows)).collect())) == by_key(want)
    assert impact_topk.search(vectors(spark, rows[:1]).limit(0)).count() == 0


def test_op12_ties(spark):
    """A third of the rows are one vector; the smallest ids win."""
    rng = np.random.default_rng(4)
    rows = [(i, [0.5] * 4 if i % 3 == 0 else rng.normal(size=4).clip(-0.4, 0.4).tolist(), 0) for i in range(300)]
    got = impact_topk.search(vectors(spark, rows)).filter("query_id = 150").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(v, 4 * 128 * 128) for v in (0, 3, 6, 9, 12)]


def brute_codes(rows):
    kept, x = whole(rows, 1024)
    wide = len(x[0]) // 4
    packed = lambda v: np.array(v, "<i4").tobytes()
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, packed(x[i])))[:256]
    parts = [[v[p * wide : (p + 1) * wide] for v in x] for p in range(4)]
    books = [[list(parts[p][i]) for i in first] for p in range(4)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book)) for v in part] for part, book in zip(parts, books)]

    for _ in range(4):
        for p, near in enumerate(assign()):
            for k in range(len(first)):
                mine = [v for v, (_, e) in zip(parts[p], near) if e == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    near = assign()
    error = [sum(near[p][i][0] for p in range(4)) for i in range(len(kept))]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{near[p][i][1]:02x}" for p in range(4)), error[i], sum(e for e, s in zip(error, kept) if s[2] == r[2]), sha) for i, r in enumerate(kept)]


def test_op13(spark, some):
    assert by_key(map(tuple, part_codes.compress(vectors(spark, some)).collect())) == by_key(brute_codes(some))
    few = some[:9]
    assert by_key(map(tuple, part_codes.compress(vectors(spark, few)).collect())) == by_key(brute_codes(few))
    assert part_codes.compress(vectors(spark, few).limit(0)).count() == 0
    with pytest.raises(ValueError):
        part_codes.compress(vectors(spark, [(1, [1.0] * 8, 0), (2, [1.0] * 4, 0)]))


def test_op13_prunes():
    """Pivots leave most entries unevaluated where parts lie near entries, and never the nearest."""
    rng = np.random.default_rng(5)
    entries = rng.integers(-900, 900, (256, 4))
    x = entries[rng.integers(0, 256, 3000)] + rng.integers(-40, 40, (3000, 4))
    pivots = part_codes.spread(entries, 8)
    book = part_codes.Book(entries, pivots)
    code, best = book.nearest(x, part_codes._apart(x, pivots))
    far = ((x[:, None] - entries) ** 2).sum(2)
    assert (code == far.argmin(1)).all() and (best == far.min(1)).all() and book.evaluated < 3000 * 256 / 8


@pytest.mark.parametrize("name", ["op12_impact_topk", "op13_part_codes"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    order = [[c[0] for c in want.description].index(c) for c in got.columns]
    assert by_key(map(tuple, got.collect())) == by_key(tuple(r[i] for i in order) for r in want.fetchall())


def test_op5_other_tokenizers(spark):
    """A tokenizer that cuts otherwise gets whole texts; the one with word ends is cut."""
    from tokenizers import Tokenizer

    from turnmill.llm import token_files

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(["Hello World", None, "", "a\n B  é😀"])]
    got = token_files.read(spark, token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), path)).collect()
    assert token_files.cut_alike(P.path("word_bpe_49k.json")) and not token_files.cut_alike(path)
    import zlib

    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == [(i, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for i, e in enumerate(ids)]


def test_op3_rows_without_sources(spark):
    from turnmill.llm import source_mix

    df = spark.createDataFrame([(1, ["a"], 10), (2, None, 10), (3, [], 10), (4, [None, "a"], 10), (5, [None], 0)], "doc_id long, members array<string>, size long")
    got = {r.doc_id: r.repeats for r in source_mix.mix(df, "members", "size", spark.createDataFrame([("a", 20.0)], "source string, target double")).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}


def test_op10_clashing_names(spark):
    from turnmill.llm import line_dedup, passage_dedup

    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 5, 6), (2, text + " more", 5, 6)], "doc_id long, text string, __id int, __at int")
    assert {r.doc_id: (r["__removed"], r["__id"], r["__at"]) for r in passage_dedup.dedup(df).collect()} == {1: ([], 5, 6), 2: (["0-59"], 5, 6)}
    for operator, name in ((line_dedup, "__lines"), (passage_dedup, "__Words")):
        with pytest.raises(ValueError, match="columns named"):
            operator.dedup(df.withColumnRenamed("__id", name))
