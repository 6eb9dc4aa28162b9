"""The training-data operators against libraries, brute force, round trips and held-out labels, on small tables with odd rows."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from turnmill.llm import bpe, byte_bpe, exact_dedup, jaccard_join, line_dedup, passage_dedup, quality_mil, source_mix, token_count, token_files, vector_dedup, warc_zst

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "don't  'stop\t\tnow \n x", "'s't're've'm'll'd", "a" * 700, "<|endoftext|> x<|endoftext|>", "<|ENDOFTEXT|>", "²³ ١٢ é é 　 😀!?", "\x1c a\x85b\xa0c", "one two three four", "One  two\nthree FOUR", "w " * 3000, "it's we'll I'd they're"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeated rows, a null id, extra columns with clashing names, and a table's own rows."""
    rows = [(900_000 + i, t, "x") for i, t in enumerate(ODD)] + [(900_000, None, "x"), (None, "one two three four", None)]
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("source"))
    few = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(own)
    return few.withColumn("lang", F.lit("en")).withColumn("n", F.lit(1)).withColumn("score", F.lit(0)).withColumn("size", F.lit(0)).withColumn("sid", F.lit(7)).withColumn("tile", F.lit(0))


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


def by_id(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def test_op1(spark, docs, texts):
    path = P.path("byte_bpe_50k.tiktoken")
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = by_id((i, len(e := library.encode_ordinary(t)), sha(np.array(e, "<u4").tobytes()), sha(t.encode())) for i, t, _ in texts)
    assert by_id(map(tuple, byte_bpe.round_trip(docs, path).collect())) == want
    coded = byte_bpe.encode(docs, path)
    r = coded.filter("doc_id = 900004").first()
    assert np.frombuffer(r.offsets, "<i8")[0] == 0 and len(r.offsets) == 2 * len(r.ids)
    assert bytes(byte_bpe.decode(coded, path).filter("doc_id = 900004").first().decoded) == ODD[4].encode()
    assert byte_bpe.round_trip(empty(spark), path).count() == 0


def test_classes_as_the_library():
    kinds = bpe.classes()
    for pattern, kind in ((r"\p{L}", (bpe.LETTER, bpe.STMD, bpe.R, bpe.V, bpe.E, bpe.L)), (r"\p{N}", (bpe.NUMBER,)), (r"\s", (bpe.SPACE, bpe.BLANK))):
        import tiktoken

        one = tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        some = [*range(0x3000), *range(0xA640, 0xD800, 7), 0x1C89, 0xA7CB, 0x105C0]
        assert all(bool(one.encode_ordinary(chr(c))) == (kinds[c] in kind) for c in some)
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    joins = lambda a, c: len(cut.pre_tokenize_str(a + chr(c) + a)) == 1
    for c in [*range(0x3000), *range(0xA640, 0xD800, 7), 0x1C89, 0xA7CB, 0x105C0, 0x11DE0, 0x208F]:
        assert joins("a", c) == (kinds[c] in range(bpe.LETTER, bpe.L + 1) and kinds[c] not in (bpe.NUMBER,)) and joins("1", c) == (kinds[c] == bpe.NUMBER)


def test_op4(spark, docs, texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = by_id((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t, _ in texts)
    assert by_id(map(tuple, token_count.count_tokens(docs, path).collect())) == want
    assert token_count.count_tokens(empty(spark), path).count() == 0


def test_op5(spark, docs, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ids = [library.encode(t, add_special_tokens=False).ids + [1] for _, t, _ in order]
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    want = by_id((i, s, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for (i, *_), s, e in zip(order, starts, ids))
    assert by_id(map(tuple, token_files.read(spark, token_files.write(docs, path)).collect())) == want
    assert token_files.read(spark, token_files.write(empty(spark), path)).count() == 0


def test_op7(spark, docs, texts):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    for i, t, _ in texts:
        groups[norm(t)].append(i)
    want = []
    for i, t, _ in texts:
        g = groups[norm(t)]
        low = min((x for x in g if x is not None), default=None)
        want.append((i, low, len(g), i == low, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert by_id(map(tuple, exact_dedup.dedup(docs).collect())) == by_id(want)
    assert by_id(map(tuple, exact_dedup.dedup(docs, most=2000).collect())) == by_id(want)  # spills
    assert exact_dedup.dedup(empty(spark)).count() == 0


def test_tries_spill():
    import random

    r = random.Random(3)
    words = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) + b"x" * r.choice([0, 300]) for _ in range(3000)]
    want = defaultdict(lambda: [10**9, 0])
    tries = exact_dedup.Owners(5000)
    for i, w in enumerate(words):
        tries.insert(w, i, 1)
        want[w] = [min(want[w][0], i), want[w][1] + 1]
    assert sorted((t, o, n) for t, o, n in tries.terminals()) == sorted((t, *v) for t, v in want.items())


def shingle_sets(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for _, t, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def near_brute(texts):
    sets = shingle_sets(texts)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 0.8 <= len(sets[i]) / len(sets[j]) <= 1.25 and 100 * (k := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(texts):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return by_id((d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, *_) in enumerate(texts))


def families(spark):
    """Families of copies with 0 to 40 of 100 words changed, small texts, and texts that share a passage."""
    import random

    r = random.Random(5)
    word = lambda: "w%06d" % r.randint(0, 10**6)
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(r.choice([4, 5, 6, 9, 12, 100, 300]))]
        for k in range(12):
            own = list(base)
            for _ in range(k * len(base) // 120):
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [" ".join(passage + [word() for _ in range(40)]) for _ in range(80)]
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id long, text string, source string")


def test_op8(spark, docs, texts):
    assert by_id(map(tuple, jaccard_join.components(docs).collect())) == near_brute(texts)
    assert jaccard_join.components(empty(spark)).count() == 0


def test_op8_families(spark, monkeypatch):
    df = families(spark)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    want = near_brute(rows)
    assert by_id(map(tuple, jaccard_join.components(df).collect())) == want
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)  # many blocks and open tiles
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    assert by_id(map(tuple, jaccard_join.components(df).collect())) == want


def test_op9(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + 0.09 * r.standard_normal(16)).astype("f4").tolist(), int(i % 60 % 3)) for i in range(400)]
    rows += [(i, rows[0][1], 0) for i in range(400, 450)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [1.0, None], 1), (503, [float("nan")] * 16, 1), (504, rows[1][1], None), (505, [], 1), (506, [2.0], 1), (507, [3.0], 1), (508, [-3.0], 1), (400, rows[0][1], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("n", F.lit(1))
    ok = [i for i, (_, v, y) in enumerate(rows) if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            va, vb = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and rows[a][2] == rows[b][2] and len(va) == len(vb) and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= 0.98:
                n[a] += 1
                root[find(a)] = find(b)
    low = {}
    for i, (d, *_) in enumerate(rows):
        low[find(i)] = d if low.get(find(i)) is None else low[find(i)] if d is None else min(low[find(i)], d)
    want = by_id((d, n[i], low[find(i)], d == low[find(i)]) for i, (d, *_) in enumerate(rows))
    got = by_id(map(tuple, vector_dedup.dedup(df).collect()))
    assert sum(x[1] for x in got) >= 0.99 * sum(n) and all(a[1] <= b[1] for a, b in zip(got, want))
    monkey = vector_dedup.dedup(df, recall=1.0).collect()
    assert sum(r.n_links for r in monkey) >= 0.99 * sum(n)
    assert vector_dedup.dedup(df.limit(0)).count() == 0


def thin_pairs(n=3000, pairs=40):
    """Random unit vectors of 10 labels, few of them with a partner at cosine 0.981: (rows, links of each)."""
    r = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x, y = unit(r.standard_normal((n, 64))), r.integers(0, 10, n)
    u = r.standard_normal((pairs, 64))
    u = unit(u - (u * x[:pairs]).sum(1)[:, None] * x[:pairs])
    x, y = np.r_[x, 0.981 * x[:pairs] + np.sqrt(1 - 0.981**2) * u], np.r_[y, y[:pairs]]
    links = ((x @ x.T >= 0.98) & (y[:, None] == y)).sum(1) - 1
    return [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, y))], links.tolist()


@pytest.mark.parametrize("sample, recall", [(500, 0.998), (10_000, 0.998), (10_000, 1.0)])
def test_op9_thin_pairs(spark, monkeypatch, sample, recall):
    """Few links are all found: by the bound where the sample doesn't show enough of them, by probes where it is the whole table."""
    rows, want = thin_pairs()
    monkeypatch.setattr(vector_dedup, "SAMPLE", sample)
    monkeypatch.setattr(vector_dedup, "PROBES", 100)
    got = vector_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=recall).collect()
    assert sum(want) >= 80 and [r.n_links for r in sorted(got, key=lambda r: r.vec_id)] == want


@pytest.mark.parametrize("k", [2, 5, 16])
def test_op9_bound(k):
    """No partner lies in a cell that the bound excludes, and it does exclude cells."""
    rows, _ = thin_pairs(2000, 500)
    x = np.array([v for _, v, _ in rows])
    grid = vector_dedup.Grid(x[:1000], k)
    cells, seen = grid.cells(x), set()
    for at, own, row, cell in grid.reached(x, 0.98):
        assert (own == cells[at : at + len(own)]).all()
        seen |= set(zip((at + row).tolist(), cell.tolist()))
    assert all((min(p, key=lambda i: cells[i]), max(cells[p[0]], cells[p[1]])) in seen for p in ((i, 2000 + i) for i in range(500)))
    assert len(seen) < sum(k * k - cells)


def test_op6(spark):
    own = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    long = "é" * 600
    rows = own + [(10_001, None, None), (10_002, "http://a/\nb", ""), (10_003, "u", long), (10_004, "u", long), (10_005, "u", long), (10_005, "u", long), (10_006, "u", "x" * 999), (10_007, "u", "x" * 999), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1)).withColumn("key", F.lit("k"))
    owner = defaultdict(lambda: None)
    for i, _, h in rows:
        owner[h or ""] = max((x for x in (owner[h or ""], i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 1000 and i != owner[h or ""]
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", owner[h or ""] if again else None))
    written = warc_zst.write(df)
    assert by_id(map(tuple, warc_zst.read(spark, written).collect())) == by_id(want)
    with open(written[0][0].removeprefix("file://"), "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"
    assert warc_zst.read(spark, warc_zst.write(df.limit(0))).count() == 0


def test_op3(spark, docs, texts):
    got = source_mix.mix_documents(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in texts:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = source_mix.targets({s: sizes[s] for s in order})
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(want[s] <= 2 * sizes[s] + 1e-9 for s in order)
    assert len(got) == len(texts) and all(0 <= r.taken <= 2 * r.size for r in got)
    taken, longest = defaultdict(int), max(r.size for r in got)
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    goal = defaultdict(float)
    for s in order:
        goal[sizes[s], round(want[s], 6)] += want[s]
    assert all(abs(taken[k] - goal[k]) <= longest for k in goal)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix_documents(docs.repartition(7)).collect()))
    assert source_mix.mix_documents(empty(spark)).count() == 0


def test_flow_uses_overlaps_before_repeats():
    got = source_mix.flow({("a",): 10, ("a", "b"): 20, ("b",): 5}, {"a": 15, "b": 20})
    assert sum(got.values()) == 35 and got["a",] == 10 and got["b",] == 5 and got["a", "b"] == 20
    assert source_mix.flow({("a",): 10}, {"a": 25}) == {("a",): 20}


def cheapest(patterns, quotas, most):
    """The cost of the best flow: words one by one along the cheapest path there is, by Bellman and Ford."""
    arcs = [(("o",), ("p", p), n, k * k) for p, n in patterns.items() for k in range(most)] + [(("p", p), ("s", s), most * n, 0) for p, n in patterns.items() for s in p if s in quotas] + [(("s", s), ("t",), q, 0) for s, q in quotas.items()]
    arcs = [[a, b, c, w] for a, b, c, w in arcs for a, b, c, w in ((a, b, c, w), (b, a, 0, -w))]
    total = cost = 0
    while True:
        far, via = {("o",): 0}, {}
        for _ in range(len(arcs)):
            for i, (a, b, c, w) in enumerate(arcs):
                if c and a in far and far[a] + w < far.get(b, 10**9):
                    far[b], via[b] = far[a] + w, i
        if ("t",) not in far:
            return total, cost
        total, cost, at = total + 1, cost + far["t",], ("t",)
        while at != ("o",):
            i = via[at]
            arcs[i][2] -= 1
            arcs[i ^ 1][2] += 1
            at = arcs[i][0]


def test_flow_is_the_cheapest():
    import random

    r = random.Random(2)
    for _ in range(25):
        patterns = {tuple(sorted(r.sample("abcd", r.randint(1, 3)))): r.randint(1, 6) for _ in range(4)}
        quotas, most = {s: r.randint(0, 14) for s in "abcd"}, r.choice([2, 3])
        got = source_mix.flow(patterns, quotas, most)
        cost = sum(sum(min(max(0, got[p] - k * n), n) * k * k for k in range(most)) for p, n in patterns.items())
        assert (sum(got.values()), cost) == cheapest(patterns, quotas, most)


def test_targets_over_a_table(spark):
    import random

    r = random.Random(6)
    sizes = {f"s{i:02d}é": r.choice([0, 1, 10, 100, 1000, 50_000]) for i in range(40)} | {None: 77}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)
    got = {x.source: x.target for x in source_mix.targeted(df).collect()}
    want = source_mix.targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


@pytest.mark.parametrize("leaf", [20_000, 3])
def test_mix_of_overlapping_sources(spark, leaf):
    """Against the flow in memory and a plain running sum in the seeded order, also when the search goes to its end."""
    import random

    r = random.Random(8)
    rows = [(i if r.random() < 0.8 else None, sorted(r.sample("abc", r.choice([1, 1, 2]))), r.choice([0, 1, 5, 9, 400]), "x") for i in range(300)] + [(None, ["a"], 5, "x")] * 60 + [(1, [], 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, size long, __hash string").withColumn("id", F.lit(1))
    quotas = {"a": 9000, "b": 200, "c": 30_000}
    got = source_mix.mix(df, "members", "size", spark.createDataFrame([(s, float(q)) for s, q in quotas.items()], "source string, target double"), leaf=leaf).collect()
    assert len(got) == len(rows) and {x["__hash"] for x in got} == {"x"}
    sizes = defaultdict(int)
    for _, m, n, _ in rows:
        sizes[tuple(m)] += n
    taken = source_mix.flow({p: n for p, n in sizes.items() if p}, quotas)
    hashes = {(x.doc_id, x.size): x.h for x in df.select("doc_id", "size", F.xxhash64("doc_id", F.lit(17), "size").alias("h")).distinct().collect()}
    for p, n in sizes.items():
        mine = sorted((x for x in got if tuple(x.members) == p and x.size), key=lambda x: hashes[x.doc_id, x.size])
        want, run = [], 0
        for x in mine:
            run += x.size
            want.append((x.doc_id, x.size, taken.get(p, 0) // n + (run - x.size / 2 <= taken.get(p, 0) % n and taken.get(p, 0) % n > 0)))
        assert sorted(map(str, want)) == sorted(str((x.doc_id, x.size, x.repeats)) for x in mine)
    assert all(x.repeats == 0 for x in got if not x.size)


def test_op2(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(900_000 + i, t) for i, t in enumerate(ODD)] + [(None, "x")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit(5)).withColumn("quality", F.lit(9))
    noisy = labels.unionByName(labels.limit(3)).unionByName(labels.limit(1).withColumn("quality", F.lit(None).cast("int")))
    got = quality_mil.classify(every, noisy)
    rows = got.collect()
    assert len(rows) == 1000 + len(ODD) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    known = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in known) >= 0.95 * len(known)
    assert quality_mil.classify(every.limit(0), noisy).count() == 0 and quality_mil.classify(every.limit(5), noisy.limit(0)).count() == 5


def test_op10(spark, docs):
    para = lambda i: " ".join(f"p{i}x{k}" for k in range(20))
    block = [para(k) for k in range(4)]
    rows = [(1, "\n".join(["top", *block, "end"])), (2, "\n".join([*block, "other"])), (3, "\n".join(block[:2])), (4, "\n".join(block[1:] + ["", ""] + block)), (5, "\n".join(block[:3])), (5, "\n".join(block[:3])), (6, None), (7, "\n\n\n"), (None, "\n".join(block))]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text").distinct())
    lines = [(r.doc_id if r.doc_id is not None else 2**63 - 1, r.text or "") for r in df.collect()]
    key = {(d, t): spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t", F.lit(3))).first()[0] if sum(x == d for x, _ in lines) > 1 else 0 for d, t in lines}
    seen, gone, occ = sorted(set(lines), key=lambda x: (x[0], key[x])), defaultdict(set), defaultdict(list)
    for a, (_, t) in enumerate(seen):
        own = t.split("\n")
        size = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in own]
        for i, x in enumerate(own):
            best = 0
            for b, j in occ[x]:
                other, k = seen[b][1].split("\n"), 0
                while i + k < len(own) and j + k < len(other) and own[i + k] == other[j + k]:
                    k += 1
                best = max(best, k)
            if best and sum(size[i : i + best]) >= 50:
                gone[seen[a]] |= set(range(i, i + best))
            occ[x].append((a, i))
    want = sorted((d, ",".join(map(str, sorted(gone[d, t]))), hashlib.sha256("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t]).encode()).hexdigest()) for d, t in lines)
    got = sorted((r.doc_id if r.doc_id is not None else 2**63 - 1, r.removed, r.text_sha256) for r in line_dedup.digest(df).collect())
    assert got == want and any(r for _, r, _ in got)
    assert line_dedup.digest(empty(spark)).count() == 0


def test_op10_passages(spark, docs):
    """Passages inside lines, case, overlaps and repeated rows, against brute force over all windows of 50 words."""
    w = lambda a, n, k="p": " ".join(f"{k}{i}" for i in range(a, a + n))
    rows = [(1, f"begin {w(0, 120)} end"), (2, f"x\ny {w(10, 60)} z  \n"), (3, w(0, 49)), (4, w(30, 50).upper()), (5, f"{w(0, 50)}\n\té {w(60, 60)}  "), (5, f"{w(0, 50)}\n\té {w(60, 60)}  "), (6, w(5, 50)), (7, f"{w(0, 70, 'q')} {w(0, 70, 'q')}"), (None, f"🙂 {w(20, 55)} 🙂"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text").distinct()).withColumn("uid", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(3)))
    every = [(r.doc_id if r.doc_id is not None else 2**63 - 1, r.uid, r.text or "") for r in df.collect()]
    first, left = {}, {}
    for d, u, t in sorted(set(every)):
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        own, gone = [t[a:b] for a, b in at], set()
        for i in range(len(own) - 49):
            if first.setdefault(tuple(own[i : i + 50]), (d, u, i)) != (d, u, i):
                gone |= set(range(i, i + 50))
        keep, out, now = [i for i in range(len(own)) if i not in gone], "", 0
        for i in sorted(gone):
            out += t[now : max(now, at[i][0])] if i - 1 not in gone else ""
            now = at[i + 1][0] if i + 1 < len(own) else at[i][1]
        left[d, u] = len(own), len(own) - len(keep), hashlib.sha256((out + t[now:]).encode()).hexdigest()
    size = lambda x: sum(int(b) - int(a) + 1 for a, b in (p.split("-") for p in x.split(",") if p))
    got = sorted((r.doc_id if r.doc_id is not None else 2**63 - 1, r.n_words, size(r.removed), r.text_sha256) for r in passage_dedup.digest(df).collect())
    assert got == sorted((d, *left[d, u]) for d, u, _ in every)
    assert {2, 5, 6, 7} <= {d for d, _, n, _ in got if n} and not {1, 3, 4, 8} & {d for d, _, n, _ in got if n}
    assert passage_dedup.digest(empty(spark)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("note", F.lit("kept"))
    d = docs
    for name, stage in c.STAGES:
        out = stage(spark, d, SF)
        if name == "encoded":
            break
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in d.select("doc_id").collect()}, [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= before and after
        if name == "exact":
            assert set(after) == {r.doc_id for r in exact_dedup.dedup(d).filter("kept").collect()}
        if name == "near":
            assert set(after) == {i for i, _, k in near_brute([(r.doc_id, r.text or "", "") for r in d.collect()]) if i == k}
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
    assert out.count() == d.count() == c.run(spark, SF).count()


def test_pipeline_repeated_ids(spark):
    """Rows with one doc_id are told apart: one row of each group stays, and the mix counts each row once."""
    import corpus_pipeline as c

    w = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, w("a")), (1, w("a")), (1, w("a")), (2, w("b")), (3, w("b")), (3, w("c")), (None, w("d")), (None, w("d")), (4, w("c") + " more"), (5, w("e")), (5, w("e") + " less")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    once = c.exact(spark, docs, SF)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert pairs(once) == sorted([(1, w("a")), (2, w("b")), (3, w("c")), (None, w("d")), (4, w("c") + " more"), (5, w("e")), (5, w("e") + " less")], key=str)
    assert pairs(c.near(spark, once, SF)) == sorted([(1, w("a")), (2, w("b")), (3, w("c")), (None, w("d")), (5, w("e"))], key=str)
    taken = c.mixed(spark, docs, SF)
    from collections import Counter

    size, held = lambda t: len(t.split()), Counter(pairs(docs))
    got, goal = pairs(taken), source_mix.targets({"s": sum(size(t) for _, t in rows)})["s"]
    assert taken.columns == docs.columns and abs(sum(size(t) for _, t in got) - goal) <= max(size(t) for _, t in rows)
    assert all(n <= source_mix.MOST * held[x] for x, n in Counter(got).items())


def test_op5_pieces_as_the_library():
    """Latin-1 texts of hard characters, cut and put together, give the library's ids; so do texts that hold others."""
    import random

    from tokenizers import Tokenizer

    path, r = P.path("word_bpe_49k.json"), random.Random(4)
    library = Tokenizer.from_file(path)
    latin = "aZé'sStTdmlvre ..,!\n\t\x1c\x85\xa0²¼ªµß×÷ÿÀÞ19<|>\x00\x7f"
    texts = ["".join(r.choice(latin + other) for _ in range(r.randint(0, 30))) for other in ("", "ΣİΏ中😀’") for _ in range(3000)] + ["A<|endoftext|>b <|ENDOFTEXT|> 's", "x" * 70_000]
    coder = token_files.Encoder(path, "<u2", 1)
    for k in range(0, len(texts), 500):
        got = [np.frombuffer(x, "<u2").tolist() for x in coder.encode(texts[k : k + 500])]
        assert got == [e.ids + [1] for e in library.encode_batch(texts[k : k + 500], add_special_tokens=False)]


def test_cache_keeps_what_a_batch_needs():
    from turnmill.llm.common import Cache

    cache = Cache(2000)
    for k in range(50):
        wanted = {f"w{(k * 7 + i) % 40}" for i in range(12)}
        new = cache.missing(wanted)
        cache.add(new, [w.upper() for w in new])
        assert all(cache[w] == w.upper() for w in wanted) and len(cache) <= 2000 // 200 + 12


def test_op2_as_loops():
    """Passages, attention, scores and gradients against plain loops over documents."""
    r = np.random.default_rng(3)
    texts = ["", "a b c.", "One two  two two! " * 200, "é" * 700, "x" * 1024, "line\n" * 900]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    x, first = quality_mil.passages(np.frombuffer(data, np.uint8), offsets)
    assert np.diff(np.append(first, len(x))).tolist() == [max(1, -(-len(t.encode()) // 1024)) for t in texts]
    own = [quality_mil.passages(np.frombuffer(t.encode() or b"", np.uint8), np.array([0, len(t.encode())]))[0] for t in texts[1:3]]
    assert all(np.allclose(a, x[first[i] : first[i + 1]]) for i, a in zip((1, 2), own))
    m = quality_mil.Model(seed=1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    bags = [r.standard_normal((n, quality_mil.FEATURES)) for n in (1, 3, 60)]
    begin = np.array([0, 1, 4])
    y, kept = m.forward(np.concatenate(bags), begin)
    for bag, score in zip(bags, y):
        h = [np.tanh(row @ m.p["W"] + m.p["b"]) for row in bag]
        e = np.array([float((np.tanh(v @ m.p["V"]) / (1 + np.exp(-(v @ m.p["U"])))) @ m.p["g"][:, 0]) for v in h])
        a = np.exp(e) / np.exp(e).sum()
        assert abs(1 / (1 + np.exp(-(sum(w * v for w, v in zip(a, h)) @ m.p["c"][:, 0] + m.p["d"][0]))) - score) < 1e-9
    want = np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.where(want > 0, np.log(m.forward(np.concatenate(bags), begin)[0]), np.log(1 - m.forward(np.concatenate(bags), begin)[0])))
    for name, g in m.gradients(y, want, kept).items():
        at = tuple(r.integers(0, n) for n in m.p[name].shape)
        m.p[name][at] += 1e-5
        up = loss()
        m.p[name][at] -= 2e-5
        slope = (up - loss()) / 2e-5
        m.p[name][at] += 1e-5
        assert abs(slope - g[at]) < 1e-5 + 1e-3 * abs(slope)


def test_op2_reads_a_repeated_id_once(spark):
    docs = spark.createDataFrame([(1, "good words here", 1)] * 30 + [(2, "x|x|x|x", 2)], "doc_id long, text string, __text int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = quality_mil.scored(docs, quality_mil.train(docs, labels))
    assert got.columns == ["doc_id", "text", "__text", "score"] and got.count() == 31 and got.select("doc_id", "score").distinct().count() == 2


def test_op8_tells_names_apart():
    """Sets whose first hash is shared get the second as their name."""
    sets = [np.sort(np.array(x, np.uint64)) for x in ([1, 2, 3], [4, 5], [1, 2, 3], [])]
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    plain, second = jaccard_join.set_ids(flat, at), jaccard_join.set_ids(flat, at, salt=20)
    shared = np.sort(np.array([plain[0], -5], np.int64))
    got = jaccard_join.set_ids(flat, at, shared)
    assert got[0] == got[2] == second[0] and got[1] == plain[1] and got[3] == plain[3] and plain[0] == plain[2] != plain[1]


def test_op9_thin_pairs_in_many(spark):
    """24 pairs in 60,000 vectors, too few for probes to show: the exact search finds all of them, and labels are compared as they are."""
    r = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(r.standard_normal((60_000, 32)))
    u = r.standard_normal((24, 32))
    u = unit(u - (u * x[:24]).sum(1)[:, None] * x[:24])
    x = np.r_[x, 0.985 * x[:24] + np.sqrt(1 - 0.985**2) * u]
    label = [f"l:{i % 7}" for i in range(60_000)] + [f"l:{i % 7}" for i in range(24)]
    df = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(zip(x.tolist(), label))], "vec_id long, embedding array<double>, label string")
    got = vector_dedup.dedup(df).filter("n_links > 0").collect()
    found = {tuple(sorted((g.vec_id, g.component_id))) for g in got if g.vec_id != g.component_id}
    assert len({(i, 60_000 + i) for i in range(24)} & found) >= 0.99 * 24


def test_op9_blocks_and_parts(spark, monkeypatch):
    """A cell of many members and visitors is counted the same when both are split."""
    r = np.random.default_rng(12)
    base = r.standard_normal((3, 8))
    rows = [(i, (base[i % 3] + 0.05 * r.standard_normal(8)).tolist(), 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")
    want = sorted(map(tuple, vector_dedup.dedup(df, recall=1.0).collect()))
    monkeypatch.setattr(vector_dedup, "BLOCK", 7)
    monkeypatch.setattr(vector_dedup, "VISITORS", 11)
    assert sorted(map(tuple, vector_dedup.dedup(df, recall=1.0).collect())) == want and any(n for _, n, _, _ in want)


def test_very_long_texts(spark):
    """Texts beyond a chunk, beside others: every operator over texts takes them whole."""
    from tokenizers import Tokenizer

    long = "One two three four five six seven eight. " * 60_000
    rows = [(1, long, "s"), (2, "short text of five words", "s"), (3, long, "s"), (4, "word " + long, "t"), (None, "short text of five words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert len(long) > 2_000_000
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {i: r.n_tokens for i, r in ((r.doc_id, r) for r in token_count.count_tokens(df, P.path("byte_bpe_50k.json")).collect())}
    assert n[1] == n[3] == len(library.encode(long, add_special_tokens=False).ids) and n[2] == 5
    coded = {r.doc_id: r for r in byte_bpe.round_trip(df, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert coded[1].n_tokens == n[1] and coded[4].decoded_sha256 == hashlib.sha256(("word " + long).encode()).hexdigest()
    assert {r.doc_id: r.keep_id for r in exact_dedup.dedup(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, None: 2}
    near = {r.doc_id: r for r in jaccard_join.components(df).collect()}
    assert near[4].component_id == 1 and near[1].n_shingles == 8
    assert {r.doc_id: r.n_removed for r in line_dedup.digest(df).collect()}[3] == 1


def test_pipeline_stages_against_brute_force(spark):
    """Repeated and null ids, null and empty texts, columns with the stages' own names, and no rows at all."""
    from collections import Counter

    import corpus_pipeline as c

    w = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, w("a")), (1, w("a")), (2, None), (None, None), (3, ""), (4, w("b")), (5, w("b").replace(" ", "\n")), (6, w("b") + " more"), (None, w("c")), (None, w("c")), (7, w("c") + " x"), (8, "one"), (9, "ONE")]
    docs = spark.createDataFrame([(i, t, "en", "s" if k % 3 else None, 0, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, __row long").withColumn("__score", F.lit("s")).withColumn("__repeats", F.lit("r")).withColumn("__k", F.lit("k"))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    once = c.exact(spark, docs, SF)
    best: dict = {}
    for i, t in rows:
        best[norm(t)] = min(best.get(norm(t), (2**64, "")), (2**63 if i is None else i, t or ""))
    assert once.columns == docs.columns and Counter((2**63 if i is None else i, t or "") for i, t in pairs(once).elements()) == Counter(best.values())
    left = c.near(spark, once, SF)
    held = sorted(((2**63 if r.doc_id is None else r.doc_id, r.text or "") for r in once.collect()))
    sets, gone = shingle_sets([(0, t, "") for _, t in held]), set()
    root = list(range(len(held)))
    for a in range(len(held)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root] if root[b] < root[a] else [root[a] if x == root[b] else x for x in root]
    gone = {i for i, x in enumerate(root) if x != i}
    assert left.columns == docs.columns and Counter((2**63 if i is None else i, t or "") for i, t in pairs(left).elements()) == Counter(x for i, x in enumerate(held) if i not in gone)
    taken = c.mixed(spark, left, SF)
    assert taken.columns == docs.columns and all(n <= source_mix.MOST * pairs(left)[x] for x, n in pairs(taken).items())
    out = c.encoded(spark, taken, SF)
    assert out.count() == taken.count() and Counter(r.decoded_sha256 for r in out.collect()) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in pairs(taken).elements())
    kept = c.quality(spark, docs, SF)
    assert kept.columns == docs.columns and not pairs(kept) - pairs(docs)
    none = docs.limit(0)
    assert all(stage(spark, none, SF).count() == 0 for _, stage in c.STAGES)
