"""The registered queries over the smallest tables, against SQL or the contracts' own words."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from lexigrain.llm.queries import ORACLES, QUERIES

from ..oracle import both, connect
from .test_secrets import slow
from .test_simhash import roots, slow_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    got = QUERIES[name](spark, SF).collect()
    assert len(got) == len({r.doc_id for r in got})
    return {r.doc_id: r for r in got}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    ours, theirs = both(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert ours and ours == theirs


def test_op1(spark, texts):
    got = rows(spark, "op1_simhash")
    prints = {i: slow_print(t) for i, t in texts.items()}
    root = roots(prints, [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_op2(spark, texts):
    got = rows(spark, "op2_flac")
    assert set(got) == set(texts)
    for i, r in got.items():
        raw = texts[i].encode()
        raw_padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(raw_padded), hashlib.sha256(raw_padded).hexdigest(), zlib.crc32(raw_padded[-32:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature


@pytest.mark.parametrize("name,mod,rest", [("op3_toxicity", 4, 2), ("op8_quality", 5, 0)])
def test_classifiers(spark, texts, name, mod, rest):
    got = rows(spark, name)
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % mod == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op5(spark, texts):
    got = rows(spark, "op5_resharding")
    size, slots = defaultdict(int), defaultdict(list)
    for i, r in got.items():
        raw = texts[i].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean, most = sum(size.values()) / 8, max(r["size"] for r in got.values())
    assert set(got) == set(texts) and set(size) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(abs(s - mean) <= most for s in size.values())


def test_op7(spark, texts):
    got = rows(spark, "op7_secrets")
    assert set(got) == set(texts)
    for i, r in got.items():
        base = slow(texts[i])
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in base) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == [s for s in line.split(",") if s]


def test_op10_leaks_hold_the_items(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = QUERIES["op10_decontam"](spark, SF).collect()
    whole = {(i, k) for i, t in texts.items() for k, x in items.items() if x in t}
    assert whole <= {(r.doc_id, r.item_id) for r in got} and all(r.coverage >= 0.6 for r in got)
