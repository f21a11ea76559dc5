"""Each stage of the pipeline against a brute-force version, on rows with nulls, ties, repeats and extra columns."""

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor

import corpus_pipeline as cp
from inkveil.llm import toxicity
from inkveil.llm.mixing import targets

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, _copies string, severity string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Labels for the toxicity stage: every fourth of the first 160 documents is toxic."""
    path = tmp_path_factory.mktemp("sf")
    import pyarrow as pa

    pq.write_table(pa.table({"doc_id": pa.array(range(160), pa.int64()), "quality": pa.array([1] * 160, pa.int32()), "toxic": pa.array([int(i % 4 == 0) for i in range(160)], pa.int32())}), path / "labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(200):
        words = [f"w{x}" for x in rng.integers(0, 3000, 20 + i % 40)]
        rows.append((i, " ".join(words + ["moron"] * (i % 4 == 0)), "en", None if i % 5 == 0 else f"s{i % 3}", i, "c", "s"))
    for i in range(40):  # near copies: a word or two changed
        words = rows[i + 41][1].split()
        words[i % 7] = f"edit{i}"
        rows.append((300 + i, " ".join(words), "en", "s1", 0, None, None))
    rows += [(None, rows[1][1], "en", "s1", 1, None, None), (5, rows[2][1], "de", None, 1, None, None), (7, rows[3][1] + " end", "de", "s2", 1, None, None)]
    rows += [rows[9], rows[9], (None, None, None, None, None, None, None), (None, None, None, None, None, None, None), (400, "", "en", "s0", 0, None, None), (401, " \n", "en", "s0", 0, None, None), (402, "one", "en", "s0", 0, None, None)]
    return spark.createDataFrame(rows, FIELDS)


def test_toxicity(spark, docs, folder):
    kept = cp.toxicity(spark, docs, folder)
    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted((tuple(r) for r in docs.collect() if "moron" not in (r.text or "")), key=str)
    assert cp.toxicity(spark, docs.limit(0), folder).count() == 0


def test_exact_duplicates(spark, docs, folder):
    best = {}
    for r in docs.collect():
        k = r.text or ""
        if k not in best or (r.doc_id is not None and (best[k] is None or r.doc_id > best[k])):
            best[k] = r.doc_id
    got = cp.exact_duplicates(spark, docs, folder)
    assert got.columns == docs.columns and sorted(((r.text or "", r.doc_id) for r in got.collect()), key=str) == sorted(best.items(), key=str)
    assert cp.exact_duplicates(spark, docs.limit(0), folder).count() == 0


def brute_groups(texts, k=5):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_near_duplicates(spark, docs, folder, broadcast):
    rows = [tuple(r) for r in docs.distinct().collect()]
    group = dict(zip(rows, brute_groups([r[1] for r in rows]), strict=True))
    got = rows_of(cp.near_duplicates(spark, docs, folder, broadcast))
    assert sorted(group[r] for r in got) == sorted(set(group.values()))  # one row of each group, none twice
    assert len(got) < len(rows) < docs.count()
    assert cp.near_duplicates(spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_mixed_sources(spark, docs, folder, broadcast):
    size, most = {}, {}
    before, got = [tuple(r) for r in docs.collect()], rows_of(cp.mixed_sources(spark, docs, folder, broadcast))
    for r in before:
        n = len((r[1] or "").split())
        size[r[3]] = size.get(r[3], 0) + n
        most[r[3]] = max(most.get(r[3], 0), n)
    goal, taken = targets(list(size.items())), dict.fromkeys(size, 0)
    for r in got:
        taken[r[3]] += len((r[1] or "").split())
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in size)
    assert set(got) <= set(before) and all(got.count(r) <= 2 * before.count(r) for r in set(got))
    assert got == rows_of(cp.mixed_sources(spark, docs, folder, broadcast))
    assert cp.mixed_sources(spark, docs.limit(0), folder).count() == 0


def test_piece_ids(spark, docs, folder):
    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = cp.piece_ids(spark, docs, folder)
    assert got.columns == [*docs.columns, "piece_ids", "n_pieces"] and got.count() == docs.count()
    for r in got.collect():
        assert r.piece_ids == (None if r.text is None else sp.encode(r.text)) and r.n_pieces == (None if r.text is None else len(r.piece_ids))
    assert cp.piece_ids(spark, docs.limit(0), folder).count() == 0


def test_run_on_the_small_table(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() and out.columns[:2] == ["doc_id", "text"]


def test_held_out_toxicity(spark):
    """Of labelled rows that the model wasn't fitted on, nearly all toxic ones are rejected and nearly no clean ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.filter("doc_id % 2 = 0")
    model = toxicity.train(docs, half)
    got = toxicity.grade_toxicity(docs.select("doc_id", "text"), model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("toxic", "rejected").collect()
    toxic = [r.rejected for r in got if r.toxic]
    clean = [r.rejected for r in got if not r.toxic]
    assert len(toxic) > 100 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
