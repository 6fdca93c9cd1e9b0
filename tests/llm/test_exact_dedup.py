import hashlib
import random

import pytest
from pyspark.sql import functions as F

from finsieve.llm import common
from finsieve.llm import exact_dedup as e
from finsieve.llm.common import shared_path
from finsieve.llm.queries import ORACLES, op4_exact_dedup

from ..compare import oracle, rows


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(pairs):
    keep, size = {}, {}
    for i, t in pairs:
        k = lower(t)
        size[k] = size.get(k, 0) + 1
        if k not in keep or (i is not None and (keep[k] is None or i > keep[k])):
            keep[k] = i
    return [(i, keep[lower(t)], size[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in pairs]


TEXTS = [None, "", "A", "a", "É", "é", "İ", "i̇", "ſ", "s", "S", "K", "k", "x" * 100_000, "X" * 100_000, "a ", "a\x00"]


@pytest.mark.parametrize("digest", [None, e.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("same")])
def test_equals_brute_force_even_if_digests_clash(docs_of, digest):
    draw = random.Random(2)
    texts = TEXTS + [draw.choice(TEXTS[2:13]) for _ in range(60)]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    got = e.exact_duplicates(docs_of(texts, ids=ids), digest=digest).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(brute(list(zip(ids, texts))))
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_repeated_rows_and_null_ids(docs_of):
    got = e.exact_duplicates(docs_of(["a", "a", "A", "b", "b"], ids=[1, 1, None, None, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == [("1", "1", 3), ("1", "1", 3), ("None", "1", 3), ("None", "None", 2), ("None", "None", 2)]
    assert sum(r["kept"] for r in got) == 2
    assert e.exact_duplicates(docs_of(["a"]).limit(0)).count() == 0


def test_filter_keeps_one_row_with_all_columns(docs_of):
    docs = docs_of(["a", "A", "b", "b", "c", None, ""], ids=[1, 2, 3, 3, None, 5, 4])
    kept = e.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("2", "A"), ("3", "b"), ("5", "None"), ("None", "c")]


def test_state_is_carried_on_over_batches_and_restarts(spark):
    log, checkpoint = shared_path(spark, "t-log"), shared_path(spark, "t-state")
    schema = "id long, digest string, at struct<file:string,row:long>"

    def add(rows):
        spark.createDataFrame([(i, d, ("f", r)) for i, d, r in rows], schema).coalesce(1).write.mode("append").parquet(log)

    fields = spark.createDataFrame([], schema).schema
    add([(1, "x", 0), (2, "y", 1)])
    add([(7, "x", 2)])
    known = {r["digest"]: (r["keep"]["id"], r["group_size"]) for r in e.stream_state(spark, log, fields, checkpoint, batch_bytes=1).collect()}
    assert known == {"x": (7, 2), "y": (2, 1)}
    add([(3, "x", 3), (9, "y", 4), (4, "z", 5)])
    known = {r["digest"]: (r["keep"]["id"], r["group_size"]) for r in e.stream_state(spark, log, fields, checkpoint).collect()}
    assert known == {"x": (7, 3), "y": (9, 2), "z": (4, 1)}


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with e.settings(spark, e.STATE_CONF):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == before


def test_no_store_stays_open(spark, docs_of):
    module = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.streaming.state, "StateStore$"), "MODULE$")
    field = module.getClass().getDeclaredField("loadedProviders")
    field.setAccessible(True)
    module.unloadAll()
    assert e.exact_duplicates(docs_of([f"text {i % 40}" for i in range(100)])).where("kept").count() == 40
    assert field.get(module).size() == 0


def test_whole_query(spark, sf_dir):
    made = op4_exact_dedup(spark, sf_dir).toPandas()
    assert rows(made) == rows(oracle(ORACLES["op4_exact_dedup"], sf_dir))


def test_more_hits_than_may_be_broadcast(docs_of, monkeypatch):
    monkeypatch.setattr(e, "BROADCAST_ROWS", 2)
    texts = ["a", "A", "b", "B", "b", "c", "a"]
    docs = docs_of(texts)
    got = e.exact_duplicates(docs, digest=lambda c: F.lit("same")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(brute(list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in e.drop_exact_duplicates(docs).collect()) == [4, 5, 6]


def test_only_texts_that_were_met_before_are_hits(spark, docs_of):
    source = e.located(docs_of(["a", "b", "A", "c"], ids=[1, 2, 3, 4]))
    found = e.judged(source, "doc_id", "text")
    texts = source.select("doc_id", "text", e.locator().alias("at"))
    assert sorted(r["doc_id"] for r in e.hits(texts, found).collect()) == [1, 3]
    plan = e.hits(texts, found)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_columns_with_odd_names(spark):
    docs = spark.createDataFrame([(1, "a", 7, 8, 9, 10), (2, "A", 1, 2, 3, 4)], "doc_id long, text string, `a.b` int, at int, `_metadata` int, `x``y` int")
    kept = e.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "A", 1, 2, 3, 4)]
    renamed = docs.withColumnsRenamed({"doc_id": "doc.id", "text": "the.text"})
    assert e.exact_duplicates(renamed, "doc.id", "the.text").columns[0] == "doc.id"


def test_files_of_one_run_are_deleted(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert e.drop_exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).count()
    assert sorted({p.name.rsplit("-", 1)[0] for p in (tmp_path / "finsieve").iterdir()}) == ["digest-clashes", "digest-dropped", "digest-groups"]


def test_clusters_need_a_shared_folder():
    class Conf:
        master = "spark://somewhere:7077"

        def get(self, key, default):
            return default

        def isDefined(self):
            return False

    class Session:
        conf = sparkContext = Conf()

    Conf._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Conf()})()})()
    with pytest.raises(RuntimeError, match="share"):
        common.shared_dir(Session())
