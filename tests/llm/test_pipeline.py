import random
import re

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from ticketlens.llm import common, components, toxicity, words


def prose(rnd, n, parts=("ta", "ri", "no", "mel", "ko", "su", "lan", "ung")):
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    docs = [(i, prose(rnd, rnd.randint(30, 300)), "en", "s", 0) for i in range(400)]
    labels = []
    for i in range(0, 400, 4):
        t = docs[i][1].split()
        for _ in range(2):
            t.insert(rnd.randrange(len(t)), rnd.choice(["snarfling", "dreckbold"]))
        docs[i] = (i, " ".join(t), "en", "s", 0)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400) if i % 5]
    passage = prose(rnd, 70)
    docs += [(1000, docs[1][1], "en", "s", 0), (1001, docs[1][1], "en", "s", 0)]                           # exact copies
    docs += [(1010, docs[2][1] + " taritari", "en", "s", 0)]                                              # a near copy
    docs += [(1020 + k, prose(rnd, 120) + " " + passage + " " + prose(rnd, 120), "en", "s", 0) for k in range(3)]  # a passage
    docs += [(1100, None, None, None, None), (1101, "", "en", "s", 0), (None, "taritari no id", None, "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, passage


def test_stages(spark, folder, tmp_path):
    path, docs, passage = folder
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "suffix_dedup", "best_fit_packing"]
    table = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = table.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, table, path).write.parquet(str(tmp_path / str(k)))
        table = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert table.columns == columns
            kept.append({r.doc_id: r.text for r in table.collect()})
    bad = re.compile("snarfling|dreckbold")
    clean = {i: t for i, t, *_ in docs if not bad.search(t or "")}
    assert all(not bad.search(t or "") for t in kept[0].values())
    assert len(set(clean) - set(kept[0])) <= 0.02 * len(clean)
    assert 1001 in kept[1] and 1000 not in kept[1] and 1 not in kept[1]
    assert 2 in kept[2] and 1010 not in kept[2] and len(kept[2]) == len(kept[1]) - 1
    assert set(kept[3]) == set(kept[2])
    assert passage in kept[3][1020] and all(passage[30:-30] not in kept[3][k] and kept[3][k] for k in (1021, 1022))
    assert all(kept[3][i] == kept[2][i] for i in kept[2] if i not in (1021, 1022))
    tok = words.WordTable(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in table.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(tok.plain(t or "")) + 1 for i, t in kept[3].items()}


def test_empty_tables(spark, folder, tmp_path):
    path, *_ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, path).collect() == []


@pytest.fixture
def fine(spark):
    """A session that deals rows out to far more partitions than they need."""
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_partitions_for_little_text(fine, folder, tmp_path):
    path, docs, _ = folder
    table = fine.read.parquet(f"{path}/documents.parquet")
    text = sum(len((t or "").encode()) for _, t, *_ in docs)
    assert common.parts_for(table) == -(-text // common.PART_BYTES) == 1 and common.parts_for(table.limit(0)) == 1
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(fine, table, path)
        assert out.rdd.getNumPartitions() == 1
        out.write.parquet(str(tmp_path / str(k)))
        table = fine.read.parquet(str(tmp_path / str(k)))


def test_components_of_few_edges(fine):
    found = components.components(fine.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"))
    assert found.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(41)]


def test_no_second_kind_of_worker(spark, folder, monkeypatch):
    """Rows of the driver reach the executors without an RDD of Python rows, whose workers would stay beside the others."""
    def refuse(*a, **b):
        raise AssertionError("an RDD of Python rows")
    path, *_ = folder
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(spark.sparkContext, "parallelize", refuse)
    texts, y = toxicity.training_sample(docs, labels)
    assert len(texts) == len(y) > 100 and set(y.tolist()) == {0, 1}


def test_released():
    assert list(common.released(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]


def test_registered(spark, folder):
    names = set(entry.queries())
    assert {"pipeline"} <= names and sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= names and P.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
