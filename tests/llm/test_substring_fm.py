import re

import numpy as np

from folioscope.llm import substring_fm
from folioscope.llm.fm_index import FMIndex, repeated


def brute(rows, width):
    """id -> (words, kept words), rows once each in order of id."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(found)
        for i in range(len(found) - width + 1):
            window = tuple(found[i:i + width])
            if window in seen:
                gone[i:i + width] = [True] * width
            seen.add(window)
        out[doc_id, text] = len(found), " ".join(w for w, g in zip(found, gone) if not g)
    return out


def check(df, width):
    rows = df.select("doc_id", "text").collect()
    want = brute([tuple(r) for r in rows], width)
    got = substring_fm.deduplicate(df, width, carried=["text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["kept"]) == want[r["doc_id"], r["text"]], r["doc_id"]
        assert r["n_words"] - sum(b - a for a, b in r["removed"]) == len(r["kept"].split(" ")) * (r["kept"] != "")


def test_fm_index_against_scans():
    dice = np.random.default_rng(3)
    for trial in range(60):
        width = int(dice.integers(2, 6))
        segments = [dice.integers(1, dice.integers(2, 6), dice.integers(width, width + 30)) for _ in range(dice.integers(1, 20))]
        text = np.concatenate([np.append(s, 0) for s in segments])
        starts = np.cumsum([0, *(len(s) + 1 for s in segments[:-1])])
        counts = np.array([len(s) - width + 1 for s in segments])
        found = repeated(FMIndex(text, width), text, starts, counts, piece=5)
        seen, want = set(), np.zeros(len(text), bool)
        for a, n in zip(starts, counts):
            for p in range(a, a + n):
                want[p] = tuple(text[p:p + width]) in seen
                seen.add(tuple(text[p:p + width]))
        assert (found == want).all(), trial


def test_documents_against_brute_force(small):
    check(small, 20)


def test_hot_anchors_are_dealt_by_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_fm, "HOT_SEGMENTS", 3)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} c{i % 5} {passage} x{i % 3} y{i % 7} " + " ".join(f"z{(i * j) % 11}" for j in range(15))) for i in range(80)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 20)


def test_a_window_of_very_many_segments_fits_a_shard(spark, monkeypatch):
    monkeypatch.setattr(substring_fm, "HOT_SEGMENTS", 20)
    monkeypatch.setattr(substring_fm, "SHARD_WORDS", 500)
    real = substring_fm.shard_repeats

    def guarded(ids, rows, starts, counts, texts, width):
        assert (counts + width - 1).sum() < 4000, "a shard beyond its bound"
        return real(ids, rows, starts, counts, texts, width)

    monkeypatch.setattr(substring_fm, "shard_repeats", guarded)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'a{i}x{j}' for j in range(20))} {passage} {' '.join(f'z{i}x{j}' for j in range(20))}") for i in range(400)]
    rows += [(1000 + i, f"run{i} " + "la " * (900 + i)) for i in range(5)]  # few segments, but long ones
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 20)


def test_edges(edge, nothing):
    check(edge.where("doc_id is not null"), 20)
    left = {r["text"]: r["kept"] for r in substring_fm.deduplicate(edge, carried=["text"]).collect() if r["doc_id"] is None}
    assert left[None] == "" and left["no id here " * 9] == "no id here"
    whole = substring_fm.without_repeats(edge)
    assert whole.columns == edge.columns and whole.count() == edge.count()
    assert substring_fm.deduplicate(nothing).count() == 0
