"""One serialiser of rows: held against Python's own JSON, in the hash, the chain and its verification."""

import hashlib
import json
import math
import random
import struct

from pyspark.sql import functions as F

from turnmill.functions import scalars
from turnmill.operators import keyed

KINDS = "k long, i int, n long, s string, x double, b boolean, f float, xs array<double>, m map<string,long>, t struct<z:string,a:long>"
TEXTS = ["", "plain", '"', "\\", "\x00\x1b\x7f", "\b\f\n\r\t", "é中", "😀x", "  �", None]
NUMBERS = [0.0, -0.0, 1.0, 0.1, -2.5, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 2e23, 1e23, 5e-324, 2.2250738585072014e-308, 2e-323, 9007199254740993.0, 1.7976931348623157e308, 2.0e-3, 4.35, 1 / 3, math.inf, -math.inf, None]


def sample():
    rng = random.Random(1)
    bits = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)]
    numbers = NUMBERS + [x for x in bits if x == x] + [float(f"{rng.randint(1, 99)}e{rng.randint(-320, 300)}") for _ in range(500)] + [rng.randint(1, 10**6) / 100 for _ in range(500)]
    single = lambda x: None if x is None else struct.unpack("<f", struct.pack("<f", max(-1e30, min(1e30, x))))[0]
    return [(k, None if k % 3 else k, None if k % 2 else 9007199254740993 + k, TEXTS[k % len(TEXTS)], x, None if k % 5 == 0 else k % 2 == 0, single(x), None if k % 7 == 0 else [x, None, 1.5], {"b": k, "a": None}, ("é", k) if k % 4 else None) for k, x in enumerate(numbers)]


def plain(row, names):
    said = {c: v for c, v in zip(("k", "i", "n", "s", "x", "b", "f", "xs", "m", "t"), row) if c in names}
    if said.get("t") is not None:
        said["t"] = dict(zip("za", said["t"]))
    return said


def test_canonical_is_pythons(spark):
    rows = sample()
    df = spark.createDataFrame(rows, KINDS)
    names = ["k", "i", "n", "s", "x", "b", "f", "xs", "m", "t"]
    got = {r.k: r.said for r in df.select("k", scalars.canonical(df, *names).alias("said")).collect()}
    for r in rows:
        assert got[r[0]] == json.dumps(plain(r, names), sort_keys=True, separators=(",", ":"))


def test_chain_and_verification_agree(spark):
    """Nulls in whole numbers, a null number as host, control letters, floats: the hashes are those of a plain loop, and nothing is reported."""
    rows = sample()[:300]
    df = spark.createDataFrame([(None if r[0] % 4 == 0 else r[0] % 4, 0, *r) for r in rows], f"host long, created_at long, {KINDS}").withColumn("seq", F.col("k"))
    names = ["k", "i", "n", "s", "x", "b", "xs"]
    good = keyed.chain_rows(df, names)
    got = {r.k: (r.prev_hash, r.row_hash, r.n) for r in good.collect()}
    last = {}
    for r in rows:
        host = r[0] % 4
        said = plain(r, names) | {"prev_hash": last.get(host)}
        now = hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert got[r[0]] == (last.get(host), now, r[2])
        last[host] = now
    good = spark.createDataFrame(good.collect(), good.schema)
    assert keyed.verify_chain(good, names).count() == 0
    odd = good.withColumn("n", F.when(F.col("seq") == 9, 1).otherwise(F.col("n"))).filter("seq <> 16")
    assert sorted((r.seq, r.problem) for r in keyed.verify_chain(odd, names).collect()) == [(9, "row_hash mismatch"), (20, "prev_hash mismatch")]
    assert keyed.chain_rows(df.limit(0), names).count() == 0
