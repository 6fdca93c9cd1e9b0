"""All stages of the corpus pipeline against plain Python."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from finsieve.llm import secrets, toxicity

from .test_packing import PATH, whole
from .test_simhash import grams, groups


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_exact(docs):
    kept = {}
    for i, text, source in docs:
        kept[lower(text)] = max(kept.get(lower(text), -1), i)
    return [d for d in docs if kept[lower(d[1])] == d[0]]


def plain_near(docs):
    sets = {i: grams(text) for i, text, _ in docs}
    similar = lambda a, b: (not sets[a] and not sets[b]) or (len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8)
    first = groups(sorted(sets), similar)
    return [d for d in docs if first[d[0]] == d[0]]


def plain_masked(docs):
    found, owners, places = {}, defaultdict(set), defaultdict(set)
    for i, text, source in docs:
        base = secrets.base_spans(text or "")
        found[i] = [(a, e, (k if k else "value", v)) for a, k, e, v in base + secrets.wide_spans(text or "", base)]
        for _, _, value in found[i]:
            owners[value].add(source.split("/")[0])
            places[value].add(source)
    live = lambda v: len(owners[v]) <= 2 and len(places[v]) <= 2
    out = []
    for i, text, source in docs:
        covered = sorted((a, e) for a, e, v in found[i] if live(v))
        for a, e in reversed(secrets.union(covered)):
            text = text[:a] + "[SECRET]" * 1 + text[e:]
        out.append((i, text, source))
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returns, by its name, and what went in."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "stage")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        out.append((name, before, docs))
    return out


def rows(docs):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())


def test_toxic_documents_go(stages, spark, sf_dir):
    _, before, docs = stages[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train_on(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, toxicity.CATEGORIES)
    assert rows(docs) == sorted(d for d in before if toxicity.predict(d[1], chain)[1] < toxicity.THRESHOLD)
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(toxic & {r[0] for r in rows(docs)}) <= 0.1 * len(toxic)


def test_the_largest_of_exact_copies_stays(stages):
    _, before, docs = stages[1]
    assert rows(docs) == sorted(plain_exact(before)) and docs.count() < len(before)


def test_the_first_of_near_copies_stays(stages):
    _, before, docs = stages[2]
    assert rows(docs) == sorted(plain_near(before)) and docs.count() < len(before)


def test_live_secrets_are_masked(stages):
    _, before, docs = stages[3]
    merged = lambda t: re.sub(r"(\[SECRET\])+", "[SECRET]", t or "")
    assert [(i, merged(t)) for i, t, _ in rows(docs)] == sorted((i, merged(t)) for i, t, _ in plain_masked(before))


def test_what_is_left_is_packed(stages):
    _, before, docs = stages[4]
    whole(docs.collect(), {i: t for i, t, _ in before}, Tokenizer.from_file(PATH))


def test_run_is_the_stages_in_turn(stages, spark, sf_dir):
    made = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, made.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, stages[-1][2].select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_stages_take_odd_tables(spark, sf_dir):
    """Nulls in any column, repeated rows and ids, empty texts, extra columns of clashing names, then an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, at int, __id int, node int, live int, toxic boolean, `_metadata` int"
    long = "many words of one text " * 3000
    made = [(1, None, None, None, None), (1, "", "en", "s/1", 0), (None, "token=abcdefgh1 x", None, None, None), (2, "token=abcdefgh1 x", "en", "s", 1), (2, "token=abcdefgh1 x", "en", "s", 1), (3, long, "en", "s", 9), (4, long + "end", "en", "s", 9), (None, None, None, None, None)]
    full = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, True, 6) for r in made], schema)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "stage")
            assert docs.columns == full.columns
        left = docs.select("doc_id", "text").collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == len({r["doc_id"] for r in left})
        if left:
            assert sorted(str(r["doc_id"]) for r in left) == ["1", "2", "3"] and {r["doc_id"]: r["text"] for r in left}[2] == "[SECRET] x"


def test_locators_are_broadcast_without_paths(spark, tmp_path):
    """The driver holds a locator of two dozen bytes; rows of one number in other files stay."""
    from finsieve.llm.common import locator, without

    for name in "ab":
        spark.range(10).selectExpr("id", f"'{name}' name").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    source = spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b")
    gone = spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b").where("name = 'a' and id in (3, 7) or name = 'b' and id = 0").select(locator().alias("at")).localCheckpoint()
    left = without(source, gone)
    assert left.columns == ["id", "name"]
    assert sorted(map(tuple, left.collect())) == [(i, n) for i in range(10) for n in "ab" if (i, n) not in {(3, "a"), (7, "a"), (0, "b")}]
    joins, plans = [], [left._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        joins += [plan] if plan.nodeName() == "Join" else []
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    assert len(joins) == 1 and "string" not in joins[0].right().schema().json()
