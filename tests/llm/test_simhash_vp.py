import re

import numpy as np
import xxhash

from folioscope.llm import simhash_vp
from folioscope.llm.components import roots


def slow_fingerprint(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    hashes = [xxhash.xxh64(" ".join(found[i:i + size]).encode(), seed=42).intdigest() for i in range(max(1, len(found) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    label = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def check(df):
    rows = df.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    label = components(fps)
    least = {}
    for r, x in zip(rows, label):
        if r["doc_id"] is not None:
            least[x] = min(least.get(x, 1 << 62), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(least.get(x))) for r, f, x in zip(rows, fps, label))
    got = simhash_vp.near_duplicates(df).select("doc_id", simhash_vp.hex_of("fp").alias("f"), "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want


def test_documents_against_all_pairs(small):
    check(small)


def test_edges(edge, nothing):
    check(edge)
    assert simhash_vp.near_duplicates(nothing).count() == 0


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    """Fingerprints close to each other, so that leaves split and links are many."""
    monkeypatch.setattr(simhash_vp, "LEAF_PAIRS", 64)
    dice = np.random.default_rng(5)
    centres = dice.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = []
    for _ in range(900):
        x = int(dice.choice(centres))
        for b in dice.choice(64, dice.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in roots(simhash_vp.edges(table)).collect()}
    label = components(fps)
    groups = {}
    for f, x in zip(fps, label):
        groups.setdefault(x, set()).add(f)
    found = {}
    for f in fps:
        found.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_chain_of_nodes_has_one_root(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in roots(chain).collect()} == {(i, 0) for i in range(201)}


def test_keep_one_of_each(edge):
    found = simhash_vp.keep_one(edge)
    assert found.columns == edge.columns
    ids = [r["doc_id"] for r in found.collect()]
    assert ids.count(10) == 1 and 1 in ids and 11 not in ids  # texts 1 and 11 differ in case only
