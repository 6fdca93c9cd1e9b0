"""Registered queries of the engine's operators, and DuckDB SQL that gives the same rows another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fields import BY_KEY, FIELDS, IDENTITIES, IDENTITY_TOLERANCE, KEYS, MARKERS, MESSAGES, ORDERINGS, RATIO_BOUNDS, REQUIRED, REVENUE_LIMIT
from ..functions.numbers import NUMBER, WIDE, coerce, parse_number
from ..functions.responses import parse, unfenced
from ..operators import extract, layout, merge, router, validate
from ..sources import io
from ..sources.backends import next_action
from ..streaming import runlog
from .fixtures import CA, DUCK, INV, PAGES, PAT, SPARK, TA, box_rows_sql, frame, pages_sql, responses_sql, run_events_sql, runs_sql, samples_sql, statements_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Inputs

def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, b_ numbers, and raw_ structs of each field."""
    made = frame(spark, sf_dir, statements_sql(SPARK))
    return made.select("doc_id", "k", *[f"b_{k}" for k in KEYS], *[F.struct(F.col(f"kind_{k}").alias("kind"), F.col(f"txt_{k}").alias("txt")).alias(f"raw_{k}") for k in KEYS])


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(statements(spark, sf_dir), "raw_")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, pages_sql(SPARK))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, responses_sql(SPARK))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct("idx", "cls", "x1", "y1", "x2", "y2")
    return frame(spark, sf_dir, box_rows_sql(SPARK)).groupBy("doc_id", "page_no", "width", "height").agg(F.array_compact(F.collect_list(F.when(F.col("idx").isNotNull(), box))).alias("boxes"))


def fields(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", *more, *KEYS)


# SQL of the oracles

ST = f"st AS ({statements_sql(DUCK)})"
PG = f"pg AS ({pages_sql(DUCK)})"
RS = f"rs AS ({responses_sql(DUCK)})"


def q(text: str) -> str:
    return text.replace("'", "''")


def duck_number(x: str) -> str:
    return f"(CASE WHEN trim({x}, chr(10) || ' ') LIKE '(%' OR trim({x}, chr(10) || ' ') LIKE '-%' THEN -1 ELSE 1 END * TRY_CAST(regexp_replace({x}, '\\D', '', 'g') AS BIGINT))"


def duck_rules(v: Callable[[str], str], unreadable: bool) -> list[tuple[str, str, str]]:
    """(rule, condition, message) over values named by v."""
    plain = lambda x: f"rtrim(rtrim(CAST(CAST({x} AS DECIMAL(38,6)) AS VARCHAR), '0'), '.')"
    comma = lambda x: f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || format('{{:,}}', CAST(trunc(abs(CAST({x} AS DECIMAL(38,6)))) AS HUGEINT)) || CASE WHEN contains({plain(x)}, '.') THEN '.' || split_part({plain(x)}, '.', 2) ELSE '' END"
    out = []
    if unreadable:
        for k in KEYS:
            head, tail = MESSAGES["unreadable"].format(label=BY_KEY[k].label, value="\0").split("\0")
            out.append((f"unreadable:{k}", f"kind_{k} <> 'null' AND {v(k)} IS NULL", f"'{head}' || CASE kind_{k} WHEN 'bool' THEN 'True' ELSE '''' || txt_{k} || '''' END || '{tail}'"))
    for f in FIELDS:
        if not f.negative:
            out.append((f"negative:{f.key}", f"{v(f.key)} < 0", f"'{MESSAGES['negative'].format(label=f.label, value='')}' || {plain(v(f.key))}"))
    for i, o in enumerate(ORDERINGS):
        a, b = v(o.smaller), v(o.larger)
        out.append((f"ordering:{i}", f"abs({a}) > abs({b})", f"'{o.message} (' || {comma(a)} || ' > ' || {comma(b)} || ')'"))
    for i, n in enumerate(IDENTITIES):
        actual, total = "(" + " + ".join(v(p) for p in n.parts) + ")", v(n.total)
        out.append((f"identity:{i}", f"CAST(abs({actual} - {total}) AS DOUBLE) > CAST(abs({total}) AS DOUBLE) * {IDENTITY_TOLERANCE!r}::DOUBLE", f"'{n.message} — lệch ' || {comma(f'({actual} - {total})')} || ' (' || {comma(actual)} || ' vs ' || {comma(total)} || ')'"))
    for i, r in enumerate(RATIO_BOUNDS):
        a, b = v(r.part), v(r.base)
        ratio = f"(CAST(abs({a}) AS DOUBLE) / CAST(abs({b}) AS DOUBLE))"
        out.append((f"ratio:{i}", f"{b} <> 0 AND NOT ({ratio} BETWEEN {r.least} AND {r.most})", f"'{r.message}: ' || printf('%.2f%%', {ratio} * 100) || ' (ngoài khoảng {r.least:.0%}–{r.most:.0%})'"))
    revenue, assets = v("doanh_thu_thuan"), v("tong_tai_san")
    out.append(("revenue", f"{assets} > 0 AND CAST({revenue} AS DOUBLE) > CAST({assets} AS DOUBLE) * {REVENUE_LIMIT}", f"'{MESSAGES['revenue']}'"))
    lost = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {v(k)} IS NULL THEN '{BY_KEY[k].label}' END" for k in REQUIRED) + "], lambda x: x IS NOT NULL), ', ')"
    out.append(("required", " OR ".join(f"{v(k)} IS NULL" for k in REQUIRED), f"'{MESSAGES['required']}' || {lost}"))
    return out


def v_(k: str) -> str:
    return f"v_{k}"


def same(k: str) -> str:
    return k


def duck_list(rules: list[tuple[str, str, str]], messages: bool) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {says if messages else f"'{rule}'"} END" for rule, cond, says in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def duck_joined(rules: list[tuple[str, str, str]], messages: bool = True) -> str:
    return f"array_to_string({duck_list(rules, messages)}, chr(10))"


ALL_RULES = duck_rules(v_, True)
CHECKED = f"ck AS (SELECT *, len({duck_list(ALL_RULES, False)}) AS n_warnings, {' AND '.join(f"kind_{k} <> 'null'" for k in REQUIRED)} AS there FROM st)"


def duck_alias(key: str, text: str = "text") -> str:
    """A name's first match that isn't excluded; a phrase before it only where the name stands once at most, or its first place is free."""
    item, tried = BY_KEY[key], []
    for name in item.names:
        pattern = f"(?is){name}(.{{0,80}}?)({NUMBER})"
        if item.between:
            test = " AND ".join(f"NOT contains(lower(x[1]), '{b}')" for b in item.between)
            tried.append(f"list_filter(list_zip(regexp_extract_all({text}, '{pattern}', 1), regexp_extract_all({text}, '{pattern}', 2)), lambda x: {test})[1][2]")
        elif item.before:
            at = f"strpos(lower({text}), '{name.lower()}')"
            window = f"substr(lower({text}), greatest(1, {at} - 40), least(40, {at} - 1))"
            tried.append(f"CASE WHEN {' OR '.join(f"contains({window}, '{b}')" for b in item.before)} THEN NULL ELSE nullif(regexp_extract({text}, '{pattern}', 2), '') END")
        else:
            tried.append(f"nullif(regexp_extract({text}, '{pattern}', 2), '')")
    return "coalesce(" + ", ".join(duck_number(t) for t in tried) + ")"


def duck_code(key: str, text: str = "text") -> str:
    item = BY_KEY[key]
    found = f"nullif(regexp_extract({text}, '(?sm)(?:^|\\s){item.code}\\s*$(.{{0,80}}?)({NUMBER})', 2), '')"
    return f"CASE WHEN regexp_matches({text}, '(?i){MARKERS[item.form]}') THEN {duck_number(found)} END"


def duck_field(key: str) -> str:
    return f"coalesce({duck_alias(key)}, {duck_code(key)})"


X = f"x AS (SELECT doc_id, page_no, {', '.join(f'{duck_field(k)} AS {k}' for k in KEYS)} FROM pg)"
_UPTO = "(PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING)"
PREFIX = f"px AS (SELECT doc_id, page_no, {', '.join(f'first_value({k} IGNORE NULLS) OVER w AS {k}' for k in KEYS)} FROM x WINDOW w AS {_UPTO})"
_COUNT = " + ".join(f"CAST({k} IS NOT NULL AS INTEGER)" for k in KEYS)
PREFIX_RULES = duck_rules(same, False)
OCR = f"""
    oc AS (SELECT *, len({duck_list(PREFIX_RULES, False)}) = 0 AS stop FROM px),
    os AS (SELECT doc_id, coalesce(min(page_no) FILTER (WHERE stop), max(page_no)) AS stop_page, count(*) FILTER (WHERE stop) > 0 AS stopped FROM oc GROUP BY doc_id),
    ocr AS (SELECT oc.*, os.stop_page, os.stopped FROM oc JOIN os ON oc.doc_id = os.doc_id AND oc.page_no = os.stop_page)"""
VLM = f"""
    cl AS (SELECT *, regexp_extract(body, '(?s)\\{{.*\\}}', 0) AS js FROM rs),
    vr AS (SELECT doc_id, page_no, region_no, call_status, coalesce(js <> '', FALSE) AS parse_ok, {', '.join(f"CASE WHEN js <> '' THEN json_extract_string(js, '$.{k}') END AS {k}" for k in KEYS)} FROM cl),
    vp AS (SELECT doc_id, page_no, {', '.join(f'arg_min({k}, region_no) FILTER (WHERE {k} IS NOT NULL) AS {k}' for k in KEYS)} FROM vr GROUP BY doc_id, page_no),
    vx AS (SELECT doc_id, page_no, {', '.join(f'first_value({k} IGNORE NULLS) OVER w AS {k}' for k in KEYS)}, row_number() OVER w AS nth FROM vp WINDOW w AS {_UPTO}),
    vc AS (SELECT *, {_COUNT} AS n_found FROM vx),
    vn AS (SELECT *, n_found - lag(n_found, 1, 0) OVER (PARTITION BY doc_id ORDER BY page_no) AS n_new FROM vc),
    vi AS (SELECT *, nth - coalesce(max(CASE WHEN n_new > 0 THEN nth END) OVER {_UPTO}, 0) AS idle FROM vn),
    vt AS (SELECT *, n_found = {len(KEYS)} OR ({' AND '.join(f'{k} IS NOT NULL' for k in REQUIRED)} AND idle >= {merge.PATIENCE}) AS stop FROM vi),
    vs AS (SELECT doc_id, coalesce(min(page_no) FILTER (WHERE stop), max(page_no)) AS stop_page, count(*) FILTER (WHERE stop) > 0 AS stopped FROM vt GROUP BY doc_id),
    vlm AS (SELECT vt.*, vs.stop_page, vs.stopped FROM vt JOIN vs ON vt.doc_id = vs.doc_id AND vt.page_no = vs.stop_page),
    vcalls AS (
        SELECT vr.doc_id, count(*) AS vlm_calls, count(*) FILTER (WHERE call_status = 'failed') AS vlm_failures, count(*) FILTER (WHERE call_status = 'ok' AND NOT parse_ok) AS parse_failures
        FROM vr JOIN vs ON vr.doc_id = vs.doc_id AND vr.page_no <= vs.stop_page GROUP BY vr.doc_id)"""
TEXT = f"{ST}, {PG}, {X}, {PREFIX}"


# Numbers

@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN -1 ELSE 1 END * (doc_id * 1234567 + 1000) AS parsed FROM documents")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2: printed numbers, bracketed or with a minus in turn, back to what they are."""
    n = F.col("doc_id") * 1234567 + 1000
    dotted = F.replace(F.format_string("%,d", n), F.lit(","), F.lit("."))
    shown = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(" ("), dotted, F.lit(")"))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("-"), dotted)).otherwise(dotted)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", parse_number(shown).alias("parsed"))


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("doc_id", *[coerce(F.col(f"raw_{k}"), WIDE).alias(k) for k in KEYS])


def spelled(df: DataFrame) -> DataFrame:
    """Numbers as text with six places, which all engines write alike."""
    return df.withColumns({k: F.col(k).cast(WIDE).cast("string") for k in KEYS})


@query(f"WITH {ST} SELECT doc_id, {', '.join(f'CAST(v_{k} AS VARCHAR) AS {k}' for k in KEYS)} FROM st")
def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, D6: whole numbers, long ones, floats, booleans and texts."""
    return spelled(coerced(spark, sf_dir))


@query(f"WITH {ST} SELECT doc_id, {', '.join(f'TRY_CAST(CASE WHEN v_{k} = trunc(v_{k}) THEN v_{k} END AS BIGINT) AS {k}' for k in KEYS)} FROM st")
def coerce_whole_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 as bigint, which has no fractions and up to 19 digits."""
    return statements(spark, sf_dir).select("doc_id", *[coerce(F.col(f"raw_{k}")).alias(k) for k in KEYS])


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{NUMBER}')) AS n_tokens, {duck_number(f"nullif(regexp_extract(text, '{NUMBER}'), '')")} AS first_number FROM documents")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 on whole prose."""
    text = F.col("text")
    tokens = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), parse_number(F.get(tokens, F.lit(0))).alias("first_number"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 234567 WHEN 1 THEN 12202 ELSE 10123 END AS found FROM documents")
def number_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3: a number is found inside longer runs of digits and inside dates."""
    shown = F.when(F.col("doc_id") % 3 == 0, "1234.567").when(F.col("doc_id") % 3 == 1, "31.12.2026").otherwise("10.1234")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", parse_number(F.regexp_extract(shown, NUMBER, 0)).alias("found"))


@query(f"WITH {ST} SELECT doc_id, k, {', '.join(f'kind_{k} AS kind_{k}, txt_{k} AS txt_{k}' for k in KEYS)} FROM st")
def statement_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6: raw records."""
    return statements(spark, sf_dir).select("doc_id", "k", *[c for k in KEYS for c in (F.col(f"raw_{k}.kind").alias(f"kind_{k}"), F.col(f"raw_{k}.txt").alias(f"txt_{k}"))])


# Rules

def _rule_query(name: str, prefix: str) -> None:
    chosen = [r for r in ALL_RULES if r[0].split(":")[0] == prefix]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = statements(spark, sf_dir)
        raw = {k: F.col(f"raw_{k}") for k in KEYS}
        made = made.withColumns({k: coerce(raw[k], WIDE) for k in KEYS})
        found = [r for r in validate.rules({k: F.col(k) for k in KEYS}, raw, WIDE) if r.rule.split(":")[0] == prefix]
        return made.select("doc_id", F.array_join(validate.rule_ids(found), "\n").alias("rules"), F.array_join(validate.warnings(found), "\n").alias("said"))

    run.__name__ = run.__qualname__ = name
    query(f"WITH {ST} SELECT doc_id, {duck_joined(chosen, False)} AS rules, {duck_joined(chosen)} AS said FROM st")(run)


for _name in ("negative", "ordering", "identity", "ratio", "revenue", "required", "unreadable"):
    _rule_query(f"warn_{_name}", _name)


@query(f"WITH {ST} SELECT doc_id, {duck_joined(ALL_RULES)} AS warnings FROM st")
def warnings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 to R7 in their order."""
    return checked(spark, sf_dir).select("doc_id", F.array_join("warnings", "\n").alias("warnings"))


@query(f"WITH {ST}, {CHECKED} SELECT doc_id, there AND n_warnings = 0 AS acceptable, n_warnings, {duck_joined(ALL_RULES)} AS warnings_text FROM ck")
def acceptable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: the flagship."""
    return checked(spark, sf_dir).select("doc_id", "acceptable", F.col("n_warnings").cast("bigint").alias("n_warnings"), F.array_join("warnings", "\n").alias("warnings_text"))


NUMBER_RULES = duck_rules(v_, False)
BROKEN = f"br AS (SELECT doc_id, unnest({duck_list(NUMBER_RULES, False)}) AS rule FROM st)"


@query(f"WITH {ST}, {BROKEN} SELECT doc_id, rule FROM br")
def violations_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by joins with rule tables."""
    return validate.violations(coerced(spark, sf_dir))


@query(f"WITH {ST}, {BROKEN} SELECT rule, count(*) AS n FROM br GROUP BY rule")
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations_long(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {ST} SELECT doc_id, {' AND '.join(f"kind_{k} <> 'null'" for k in REQUIRED)} AS present FROM st")
def required_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8: before coercion."""
    return statements(spark, sf_dir).select("doc_id", validate.required_present({k: validate.present(F.col(f"raw_{k}")) for k in KEYS}).alias("present"))


@query(f"""WITH {ST}, {CHECKED} SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE there AND n_warnings = 0) AS n_acceptable, CAST(sum(v_{CA}) AS BIGINT) AS current_assets
    FROM ck JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def statement_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: verdicts by language and source with subtotals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    return checked(spark, sf_dir).join(docs, "doc_id").rollup("lang", "source").agg(F.count("*").alias("n"), F.count_if("acceptable").alias("n_acceptable"), F.sum(CA).cast("bigint").alias("current_assets"))


# Extraction

@query(f"WITH {ST}, {PG} SELECT doc_id, page_no, {duck_alias(TA)} AS value FROM pg")
def extract_alias_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "page_no", extract.by_alias(F.col("text"), BY_KEY[TA]).alias("value"))


@query(f"WITH {ST}, {PG} SELECT doc_id, page_no, {duck_alias(PAT)} AS value FROM pg")
def extract_alias_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "page_no", extract.by_alias(F.col("text"), BY_KEY[PAT]).alias("value"))


@query(f"WITH {ST}, {PG} SELECT doc_id, page_no, {duck_alias(INV)} AS value FROM pg")
def extract_alias_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "page_no", extract.by_alias(F.col("text"), BY_KEY[INV]).alias("value"))


@query(f"WITH {ST}, {PG} SELECT doc_id, page_no, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '(?i){m}') THEN '{f}' END" for f, m in MARKERS.items())}], lambda x: x IS NOT NULL), ',') AS forms FROM pg")
def form_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "page_no", F.array_join(extract.forms(F.col("text")), ",").alias("forms"))


@query(f"WITH {ST}, {PG} SELECT doc_id, page_no, {', '.join(f'{duck_code(k)} AS {k}' for k in KEYS)} FROM pg")
def extract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "page_no", *[extract.by_code(F.col("text"), BY_KEY[k]).alias(k) for k in KEYS])


@query(f"WITH {ST}, {PG} SELECT doc_id, page_no, {duck_field(TA)} AS value FROM pg")
def extract_field_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "page_no", extract.field_value(F.col("text"), TA).alias("value"))


@query(f"WITH {ST}, {PG}, {X} SELECT * FROM x")
def extract_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9, a page at a time."""
    return fields(extract.all_fields(pages(spark, sf_dir)), "page_no")


@query(f"WITH {ST}, {PG}, dt AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM pg GROUP BY doc_id) SELECT doc_id, {', '.join(f'{duck_field(k)} AS {k}' for k in KEYS)} FROM dt")
def extract_all_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 on whole documents, where markers of all forms stand together (T6)."""
    return fields(extract.all_fields(layout.document_text(pages(spark, sf_dir))))


# Merge and early stop

@query(f"WITH {TEXT} SELECT doc_id, {', '.join(f'arg_min({k}, page_no) FILTER (WHERE {k} IS NOT NULL) AS {k}' for k in KEYS)} FROM x GROUP BY doc_id")
def merge_first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_non_null(extract_all_pages(spark, sf_dir), ["doc_id"], ["page_no"])


@query(f"WITH {TEXT}, c AS (SELECT *, {_COUNT} AS n_found FROM px) SELECT *, n_found - lag(n_found, 1, 0) OVER (PARTITION BY doc_id ORDER BY page_no) AS n_new FROM c")
def merge_prefix_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.prefix_state(extract_all_pages(spark, sf_dir))


@query(f"WITH {ST}, {RS}, {VLM} SELECT doc_id, stop_page, stopped FROM vs")
def vlm_stop_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.stop_pages(merge.vlm_prefixes(router.vlm_pages(router.parsed_regions(responses(spark, sf_dir)).repartition("doc_id"))))


@query(f"WITH {TEXT}, {OCR} SELECT doc_id, stop_page, stopped FROM os")
def ocr_stop_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.stop_pages(merge.ocr_prefixes(extract_all_pages(spark, sf_dir)))


@query(f"WITH {ST}, {RS}, {VLM} SELECT * FROM vcalls")
def vlm_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.vlm_branch(responses(spark, sf_dir)).select("doc_id", "vlm_calls", "vlm_failures", "parse_failures")


# Replies

@query(f"WITH {ST}, {RS} SELECT doc_id, page_no, regexp_replace(regexp_replace(body, '^```[a-z]*\\n', ''), '\\n```$', '') AS cleaned FROM rs")
def response_fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select("doc_id", "page_no", unfenced(F.col("body")).alias("cleaned"))


@query(f"WITH {ST}, {RS}, {VLM} SELECT doc_id, page_no, call_status, parse_ok, {', '.join(f'CAST(TRY_CAST({k} AS DECIMAL(38,6)) AS VARCHAR) AS {k}' for k in KEYS)} FROM vr")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = router.parsed_regions(responses(spark, sf_dir))
    return spelled(regions.select("doc_id", "page_no", "call_status", "parse_ok", *[coerce(F.col(k), WIDE).alias(k) for k in KEYS]))


#: Replies that SQL engines read in different ways, with what strict reading makes of them: two
#: objects, repeated keys, other JSON, numbers as text, with points and of very many digits, nesting too deep to be read.
STRICT = (
    ('{"tong_tai_san": 1} {"tong_tai_san": 2}', False, None, None), ('{"tong_tai_san": 1, "tong_tai_san": 2}', True, "int", "2"), ("[1]", False, None, None),
    ('{"tong_tai_san": "1.500"}', True, "string", "1.500"), ('{"tong_tai_san": 1.5}', True, "float", "1.5"), ('{"tong_tai_san": NaN}', True, "float", "NaN"),
    ('{"tong_tai_san": ' + "7" * 5000 + "}", True, "int", "7" * 5000), ('{"tong_tai_san": ' + "[" * 100_000 + "}", False, None, None),
)


@query("SELECT doc_id, " + ", ".join(f"CASE doc_id % {len(STRICT)} " + " ".join(f"WHEN {i} THEN {f"'{x[at]}'" if isinstance(x[at], str) else x[at]}" for i, x in enumerate(STRICT) if x[at] is not None) + f" END AS {name}" for at, name in ((1, "parse_ok"), (2, "kind"), (3, "txt"))) + " FROM documents")
def response_parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that SQL engines read in different ways."""
    odd = [x[0] for x in STRICT]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.get(F.array(*[F.lit(o) for o in odd]), (F.col("doc_id") % len(odd)).cast("int")).alias("body"))
    made = docs.select("doc_id", parse(F.col("body")).alias("p"))
    return made.select("doc_id", "p.parse_ok", F.try_element_at("p.fields", F.lit(TA))["kind"].alias("kind"), F.try_element_at("p.fields", F.lit(TA))["txt"].alias("txt"))


# Routing

_ROUTE_COLUMNS = ["doc_id", *KEYS, "warnings", "final_acceptable", "vlm_needed", "vlm_calls"]


def _route(spark: SparkSession, sf_dir: str, ocr_first: bool) -> DataFrame:
    made = router.route(pages(spark, sf_dir), responses(spark, sf_dir), router.RouteConfig(ocr_first))
    return spelled(made).withColumn("warnings", F.array_join("warnings", "\n"))


_FINAL_RULES = duck_rules(same, False)
_ROUTED_RULES = duck_rules(same, True)
_FINAL = f"""
    , g AS (SELECT * REPLACE ({', '.join(f'TRY_CAST({k} AS DECIMAL(38,6)) AS {k}' for k in KEYS)}), {', '.join(f"coalesce({k}, '') AS txt_{k}, CASE {k} WHEN 'true' THEN 'bool' ELSE CASE WHEN {k} IS NULL THEN 'null' ELSE 'number' END END AS kind_{k}" for k in KEYS)} FROM f)
    SELECT doc_id, {', '.join(f'CAST({k} AS VARCHAR) AS {k}' for k in KEYS)}, {duck_joined(_ROUTED_RULES)} AS warnings,
           {' AND '.join(f"kind_{k} <> 'null'" for k in REQUIRED)} AND len({duck_list(_ROUTED_RULES, False)}) = 0 AS final_acceptable, vlm_needed, vlm_calls FROM g"""
ROUTED = f"""WITH {TEXT}, {OCR}, {RS}, {VLM},
    f AS (SELECT ocr.doc_id, NOT ocr.stopped AS vlm_needed, {', '.join(f'CASE WHEN ocr.stopped THEN CAST(ocr.{k} AS VARCHAR) ELSE coalesce(vlm.{k}, CAST(ocr.{k} AS VARCHAR)) END AS {k}' for k in KEYS)},
                 CASE WHEN ocr.stopped THEN 0 ELSE vcalls.vlm_calls END AS vlm_calls, CASE WHEN ocr.stopped THEN ocr.stop_page ELSE greatest(ocr.stop_page, vlm.stop_page) END AS pages_processed
          FROM ocr JOIN vlm ON ocr.doc_id = vlm.doc_id JOIN vcalls ON ocr.doc_id = vcalls.doc_id)"""


@query(f"{ROUTED} {_FINAL}")
def route_ocr_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route(spark, sf_dir, True).select(*_ROUTE_COLUMNS)


@query(f"WITH {ST}, {RS}, {VLM}, f AS (SELECT vlm.*, TRUE AS vlm_needed, vlm_calls FROM vlm JOIN vcalls USING (doc_id)) {_FINAL}")
def route_vlm_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route(spark, sf_dir, False).select(*_ROUTE_COLUMNS)


@query(f"{ROUTED} SELECT doc_id, pages_processed FROM f")
def route_pages_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route(spark, sf_dir, True).select("doc_id", "pages_processed")


@query(f"WITH {TEXT}, {OCR} SELECT doc_id FROM os WHERE NOT stopped")
def docs_needing_vlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.needing_model(pages(spark, sf_dir))


# Layout and page texts

BX = f"bx AS ({box_rows_sql(DUCK)})"
_SHOWN = "CAST(greatest(0, CAST(trunc(x1) AS INT) - 8) AS VARCHAR) || ',' || CAST(greatest(0, CAST(trunc(y1) AS INT) - 8) AS VARCHAR) || ',' || CAST(least(width, CAST(trunc(x2) AS INT) + 8) AS VARCHAR) || ',' || CAST(least(height, CAST(trunc(y2) AS INT) + 8) AS VARCHAR)"
_REGIONS = f"rg AS (SELECT doc_id, page_no, coalesce(string_agg({_SHOWN}, ';' ORDER BY CAST(trunc(y1) AS INT), idx) FILTER (WHERE cls = 'table'), '') AS regions FROM bx GROUP BY doc_id, page_no)"


def _shown(regions: Column) -> Column:
    return F.array_join(F.transform(regions, lambda b: F.concat_ws(",", *[b[c].cast("string") for c in ("x1", "y1", "x2", "y2")])), ";")


@query(f"WITH {BX}, {_REGIONS} SELECT * FROM rg")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.table_regions(F.col("boxes"), F.col("width"), F.col("height"))
    return boxes(spark, sf_dir).select("doc_id", "page_no", _shown(found).alias("regions"))


@query(f"WITH {BX}, {_REGIONS} SELECT doc_id, page_no, CASE WHEN regions = '' THEN '0,0,640,480' ELSE regions END AS regions FROM rg")
def regions_fail_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_regions(boxes(spark, sf_dir)).select("doc_id", "page_no", _shown(F.col("regions")).alias("regions"))


@query(f"WITH {ST}, {PG} SELECT doc_id, page_no, text || chr(10) || 'region 2 of ' || CAST(page_no AS VARCHAR) AS text FROM pg")
def page_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3, O4: two regions a page, given in the wrong order."""
    whole = pages(spark, sf_dir)
    second = whole.select("doc_id", "page_no", F.lit(2).alias("region_no"), F.concat(F.lit("region 2 of "), F.col("page_no").cast("string")).alias("text"))
    return layout.page_text(second.unionByName(whole.select("doc_id", "page_no", F.lit(1).alias("region_no"), "text")))


@query(f"WITH {ST}, {PG} SELECT doc_id, string_agg('===== PAGE ' || CAST(page_no AS VARCHAR) || ' =====' || chr(10) || text || chr(10) || chr(10), '' ORDER BY page_no) AS dump FROM pg GROUP BY doc_id")
def raw_text_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.raw_dump(pages(spark, sf_dir))


# Names and files

_NAME = "CASE page_id % 4 WHEN 0 THEN '../up/' || page_id || '.PDF' WHEN 1 THEN 'a b.' || page_id || '.png' WHEN 2 THEN 'x/' || page_id || '.exe' ELSE 'C:\\t\\' || page_id || '.jpeg' END"


@query("""SELECT page_id, page_id % 4 <> 2 AS accepted, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'exe' ELSE 'jpeg' END AS suffix,
    CASE page_id % 4 WHEN 0 THEN page_id || '_' || substr(md5(url), 1, 8) || '.pdf' WHEN 1 THEN 'a b.' || page_id || '_' || substr(md5(url), 1, 8) || '.png'
    WHEN 3 THEN page_id || '_' || substr(md5(url), 1, 8) || '.jpeg' END AS saved_as FROM pages""")
def safe_upload_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, E14; the random part comes of the URL here."""
    made = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(F.col("url").cast("binary")).alias("random"), F.expr(_NAME.replace("\\", "\\\\")).alias("name"))
    return made.select("page_id", io.safe_upload(F.col("name"), F.col("random")).alias("u")).select("page_id", "u.*")


# Runs and series

EV = f"ev AS ({run_events_sql(DUCK)})"
RN = f"rn AS ({runs_sql(DUCK)})"
_SUMS = "sm AS (SELECT run_id, kind, name, sum(value) AS value FROM ev WHERE kind <> 'info' GROUP BY run_id, kind, name)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frame(spark, sf_dir, run_events_sql(SPARK))
    return frame(spark, sf_dir, runs_sql(SPARK)).join(runlog.stage_maps(events), "run_id", "left")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, samples_sql(SPARK))


@query(f"WITH {EV}, {_SUMS} SELECT run_id, kind, name, value FROM sm")
def run_metrics_stage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frame(spark, sf_dir, run_events_sql(SPARK))
    return runlog.sums(events.where("kind <> 'info'").withColumn("k", F.lit(1)), "stage").withColumn("kind", F.lit("stage")).unionByName(runlog.sums(events, "counter").withColumn("kind", F.lit("counter"))).select("run_id", "kind", "name", "value")


@query(f"WITH {EV} SELECT run_id, name, arg_max(value, seq) AS value FROM ev WHERE kind = 'info' GROUP BY run_id, name")
def run_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3: the last write wins."""
    return runlog.last_info(frame(spark, sf_dir, run_events_sql(SPARK)))


@query(f"""WITH {EV}, {RN}, {_SUMS},
    g AS (SELECT run_id, string_agg(name || ' ' || CAST(round(value, 2) AS VARCHAR) || 's', ' | ' ORDER BY value DESC, name) FILTER (WHERE kind = 'stage') AS s,
                 string_agg(name || '=' || CAST(CAST(value AS BIGINT) AS VARCHAR), ' | ' ORDER BY name) FILTER (WHERE kind = 'counter') AS c FROM sm GROUP BY run_id)
    SELECT run_id, concat_ws(' | ', status, CAST(total_seconds AS VARCHAR) || 's tổng', s, c) AS line FROM rn LEFT JOIN g USING (run_id)""")
def run_summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run_id", runlog.summary_line(F.col("status"), F.col("total_seconds"), F.col("stages"), F.col("counters")).alias("line"))


_TOTALS = f"""WITH {EV}, {RN}, {_SUMS}, parts AS (
    SELECT 'documents_total' AS name, 1.0::DOUBLE AS value FROM rn UNION ALL SELECT 'documents_' || status || '_total', 1.0 FROM rn UNION ALL SELECT 'seconds_total', round(total_seconds, 2) FROM rn
    UNION ALL SELECT CASE kind WHEN 'stage' THEN 'stage_' || name || '_seconds_total' ELSE name || '_total' END, round(value, 2) FROM sm
    UNION ALL SELECT unnest(['documents_total', 'documents_ok_total', 'documents_error_total']), 0.0),
    tt AS (SELECT name, sum(value) AS value FROM parts GROUP BY name)"""


@query(f"{_TOTALS} SELECT * FROM tt")
def totals_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.totals(runs(spark, sf_dir))


@query(f"{_TOTALS} SELECT string_agg('# TYPE doc_ai_' || name || ' counter' || chr(10) || 'doc_ai_' || name || ' ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) || chr(10), '' ORDER BY name) AS text FROM tt")
def exposition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12; values as whole numbers here, as engines print doubles in different ways."""
    return runlog.exposition(runlog.totals(runs(spark, sf_dir)).withColumn("value", F.round("value").cast("bigint")))


SM = f"sp AS ({samples_sql(DUCK)})"
_DELTA = "dl AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY ts) AS before FROM sp), de AS (SELECT metric, ts, value, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS delta FROM dl)"


def _increased(seconds: int) -> str:
    return f"inc AS (SELECT metric, ts, value, sum(delta) OVER (PARTITION BY metric ORDER BY ts RANGE BETWEEN INTERVAL {seconds - 1} SECONDS PRECEDING AND CURRENT ROW) AS increase FROM de)"


@query(f"WITH {SM}, {_DELTA}, {_increased(3600)} SELECT metric, CAST(epoch(ts) AS BIGINT) AS ts, value, increase FROM inc")
def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.increase(samples(spark, sf_dir), 3600).withColumn("ts", F.unix_timestamp("ts"))


@query(f"""WITH {SM}, {_DELTA}, {_increased(6000)}, w AS (
        SELECT split_part(metric, '_', 2) AS target, ts, max(increase) FILTER (WHERE metric LIKE 'errors%') / 6000 AS part, max(increase) FILTER (WHERE metric LIKE 'documents%') / 6000 AS whole FROM inc GROUP BY ALL)
    SELECT target, CAST(epoch(ts) AS BIGINT) AS ts, part / whole AS ratio FROM w WHERE whole > 0""")
def counter_rate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, P4: of each target."""
    return runlog.ratios_of_rates(samples(spark, sf_dir), "errors_", "documents_", 6000).withColumn("ts", F.unix_timestamp("ts"))


@query(f"WITH {SM} SELECT metric AS target, arg_max(value, ts) AS up FROM sp GROUP BY metric")
def target_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.up(samples(spark, sf_dir))


@query(f"WITH {EV}, {RN} SELECT run_id, status, total_seconds FROM rn WHERE status = 'error'")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.failed_runs(frame(spark, sf_dir, runs_sql(SPARK)))


@query("SELECT path, modified FROM (SELECT 'run-' || CAST(user_id AS VARCHAR) AS path, max(event_id) AS modified FROM events GROUP BY user_id) ORDER BY modified DESC, path DESC LIMIT 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("modified")).select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("path"), "modified")
    return io.latest(files)


@query("SELECT * FROM (VALUES (1, 'ok', 'done', 0.0::DOUBLE), (1, 'retryable', 'wait', 2.0), (1, 'refused', 'give_up', 0.0), (2, 'ok', 'done', 0.0), (2, 'retryable', 'wait', 4.0), (2, 'refused', 'give_up', 0.0), (3, 'ok', 'done', 0.0), (3, 'retryable', 'give_up', 0.0), (3, 'refused', 'give_up', 0.0)) t(attempt, outcome, action, seconds)")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 as data: a table of the policy, not of the input."""
    rows = [(a, o, *next_action(a, o)) for a in (1, 2, 3) for o in ("ok", "retryable", "refused")]
    return spark.createDataFrame(rows, "attempt int, outcome string, action string, seconds double")


# Statements out of orders

_TPCH = """
    SELECT n_name AS nation, year(o_orderdate) AS year, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS gross, sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS discount,
           sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS tax, count(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, year(o_orderdate)"""
_TPCH_FIELDS = {
    "doanh_thu_thuan": "gross - discount", "gia_von_hang_ban": "gross {div} 2", "loi_nhuan_gop": "gross - discount - gross {div} 2",
    "loi_nhuan_truoc_thue": "gross - discount - gross {div} 2 - tax", "loi_nhuan_sau_thue": "(gross - discount - gross {div} 2 - tax) * 4 {div} 5",
    "tong_tai_san": "gross", "tai_san_ngan_han": "gross - discount", "tai_san_dai_han": "discount + n_lines % 3", "hang_ton_kho": "gross {div} (n_lines % 200 + 1)",
    "no_phai_tra": "tax", "von_chu_so_huu": "gross - tax",
}


@query(f"WITH t AS ({_TPCH}), s AS (SELECT nation, CAST(year AS INTEGER) AS year, {', '.join(f'CAST({e.format(div='//')} AS BIGINT) AS {k}' for k, e in _TPCH_FIELDS.items())} FROM t) SELECT nation, year, {', '.join(KEYS)}, {duck_joined(_FINAL_RULES, False)} AS rules FROM s")
def statement_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements per nation and year out of order lines: cents are rounded before they are summed, so sums are exact.

    Column types are as in the files, so filters and columns reach the scans; the two large tables
    are joined on the order key, nations by a join whose side the optimizer may broadcast by its size.
    """
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cents = lambda e: F.sum(F.round(e * 100).cast("bigint"))
    price = F.col("l_extendedprice")
    joined = table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = joined.groupBy(F.col("n_name").alias("nation"), F.year("o_orderdate").alias("year")).agg(cents(price).alias("gross"), cents(price * F.col("l_discount")).alias("discount"), cents(price * F.col("l_tax")).alias("tax"), F.count("*").alias("n_lines"))
    made = sums.select("nation", "year", *[F.expr(f"CAST({_TPCH_FIELDS[k].format(div='div')} AS BIGINT)").alias(k) for k in KEYS])
    return validate.validate(made).select("nation", "year", *KEYS, F.array_join("rule_ids", "\n").alias("rules"))


__all__ = ["ORACLES", "PAGES", "QUERIES"]
