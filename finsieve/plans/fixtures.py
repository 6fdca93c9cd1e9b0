"""Inputs derived from the tables, the same way in Spark SQL and in DuckDB.

The tables hold no statements, so these are made of document ids by whole-number arithmetic, with a
class of defect by doc_id % 18, and rendered as pages, boxes and model replies.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from ..fields import BY_KEY, FIELDS, KEYS

CA, INV, NCA, TA, LI, EQ, REV, COGS, GP, PBT, PAT = KEYS
BASE = dict(zip(KEYS, ("ca0", "inv0", "nca0", "ta0", "li0", "eq0", "rev0", "cogs0", "gp0", "pbt0", "pat0")))
DEFECTS = {
    CA: "CASE k WHEN 1 THEN ca0 + 10000000 WHEN 9 THEN ca0 + 1000 ELSE ca0 END",
    INV: "CASE k WHEN 2 THEN inv0 {div} 1000 WHEN 6 THEN ca0 + 1 ELSE inv0 END",
    NCA: "CASE WHEN k <> 10 THEN nca0 END",
    TA: "CASE WHEN k <> 3 THEN ta0 END",
    LI: "CASE k WHEN 4 THEN -li0 ELSE li0 END",
    REV: "CASE k WHEN 5 THEN ta0 * 11 ELSE rev0 END",
    COGS: "CASE k WHEN 12 THEN rev0 + 1 ELSE cogs0 END",
    GP: "CASE k WHEN 13 THEN -gp0 ELSE gp0 END",
    PAT: "CASE WHEN k = 11 THEN pbt0 + 1 WHEN k <> 8 THEN pat0 END",
}
#: Raw values that aren't whole numbers of 18 digits: key, class, kind, and the value's text, of which JSON and DuckDB make the same number.
ODD = (
    (REV, 14, "float", "CAST(rev0 AS STRING) || '.5'"),
    (EQ, 15, "bool", "'true'"),
    (INV, 16, "int", "CAST(ca0 AS STRING) || '123456789'"),
    (GP, 17, "float", "'-' || CAST(gp0 AS STRING) || '.25'"),
    (LI, 17, "int", "'9223372036854775807'"),
)
CLASSES = 18
PAGES = {2: (CA, INV, NCA), 3: (TA, LI, EQ), 4: (REV, COGS, GP, PBT, PAT)}


class Dialect:
    def __init__(self, spark: bool):
        self.spark, self.div = spark, "div" if spark else "//"
        self.generate = "LATERAL VIEW explode(sequence(1, 5)) p AS page_no" if spark else ", unnest(range(1, 6)) AS p(page_no)"

    def dotted(self, v: str) -> str:
        formatted = f"format_string('%,d', {v})" if self.spark else f"format('{{:,}}', {v})"
        return f"replace({formatted}, ',', '.')"


SPARK, DUCK = Dialect(True), Dialect(False)


def statements_sql(d: Dialect, docs: str = "documents") -> str:
    """doc_id, k, and for each key b_ (sound), n_ (with defects, as printed on pages), kind_ and txt_ (as raw value), json_ (sound or odd, as in replies) and, for DuckDB, v_ (the raw value as a number)."""
    columns = ["doc_id", "k"]
    for key in KEYS:
        n = DEFECTS.get(key, BASE[key]).format(div=d.div)
        kind, txt = f"CASE WHEN ({n}) IS NULL THEN 'null' ELSE 'int' END", f"CAST({n} AS STRING)"
        if key == CA:
            kind, txt = "CASE WHEN k = 7 THEN 'string' ELSE 'int' END", f"CASE WHEN k = 7 THEN {d.dotted('ca0')} ELSE {txt} END"
        if key == PAT:
            kind, txt = "CASE WHEN k = 8 THEN 'string' ELSE 'int' END", f"CASE WHEN k = 8 THEN 'abc' ELSE {txt} END"
        json = f"CAST({BASE[key]} AS STRING)"
        for _, k, odd_kind, odd in (o for o in ODD if o[0] == key):
            kind, txt, json = f"CASE WHEN k = {k} THEN '{odd_kind}' ELSE {kind} END", f"CASE WHEN k = {k} THEN {odd} ELSE {txt} END", f"CASE WHEN k = {k} THEN {odd} ELSE {json} END"
        columns += [f"{BASE[key]} AS b_{key}", f"{n} AS n_{key}", f"{kind} AS kind_{key}", f"{txt} AS txt_{key}", f"{json} AS json_{key}"]
        if not d.spark:
            columns.append(f"CASE WHEN k = 7 AND '{key}' = '{CA}' THEN CAST(ca0 AS DECIMAL(38,6)) ELSE TRY_CAST({txt} AS DECIMAL(38,6)) END AS v_{key}")
    return f"""
        SELECT {', '.join(columns)} FROM (
        SELECT *, pbt0 * 4 {d.div} 5 AS pat0 FROM (
        SELECT *, ta0 - li0 AS eq0, rev0 - cogs0 AS gp0, (rev0 - cogs0) {d.div} 2 AS pbt0 FROM (
        SELECT *, ta0 {d.div} 3 AS li0, ca0 {d.div} 5 AS inv0, rev0 * 11 {d.div} 20 AS cogs0 FROM (
        SELECT *, ca0 + nca0 AS ta0, 10000000000 + doc_id * 900007 AS rev0 FROM (
        SELECT doc_id, doc_id % {CLASSES} AS k, 20000000000 + doc_id * 1000003 AS ca0, 15000000000 + doc_id * 700001 AS nca0
        FROM {docs}) t1) t2) t3) t4) t5"""


def _row(d: Dialect, label: str, code: str, value: str, variants: bool = True) -> str:
    shown = f"CASE doc_id % 5 WHEN 1 THEN '{label.upper()}' WHEN 2 THEN '#{label[::2]}' ELSE '{label}' END" if variants else f"'{label}'"
    money = f"CASE WHEN {value} < 0 THEN '(' || {d.dotted('-' + value)} || ')' ELSE {d.dotted(value)} END"
    return f"CASE WHEN {value} IS NULL THEN '' ELSE {shown} || chr(10) || '{code}' || chr(10) || 'V.1' || chr(10) || {money} || chr(10) END"


def pages_sql(d: Dialect, docs: str = "documents") -> str:
    """doc_id, page_no, text: prose, two pages of balance sheet, the income statement, prose.

    The join is by a shuffle on doc_id, by which pages then lie as merging needs them, and which
    spreads the texts of a file that Spark can't split.
    """
    def page(n: int, marker: str, blurred: str) -> str:
        parts = [f"'Mẫu số ' || CASE WHEN doc_id % 3 = 0 THEN '{blurred}' ELSE '{marker}' END || ' - DN' || chr(10)"]
        for key in PAGES[n]:
            parts.append(_row(d, BY_KEY[key].label, BY_KEY[key].code, f"n_{key}"))
            if key == INV:
                parts.append(f"CASE WHEN doc_id % 5 = 3 THEN {_row(d, 'Dự phòng giảm giá hàng tồn kho', '149', f'b_{INV}', False)} ELSE '' END")
            if key == EQ:
                parts.append(f"CASE WHEN doc_id % 5 = 4 THEN {_row(d, 'Lợi nhuận sau thuế chưa phân phối', '421', f'b_{PAT}', False)} ELSE '' END")
        return " || ".join(parts)

    return f"""
        SELECT s.doc_id, CAST(page_no AS INT) AS page_no, CASE page_no
            WHEN 2 THEN {page(2, 'B01a', 'BOla')} WHEN 3 THEN {page(3, 'B01a', 'BOla')} WHEN 4 THEN {page(4, 'B02a', 'BO2a')}
            ELSE body END AS text
        FROM (SELECT /*+ MERGE(s) */ s.*, coalesce(t.text, '') AS body FROM ({statements_sql(d, docs)}) s JOIN {docs} t ON s.doc_id = t.doc_id) s {d.generate}"""


def responses_sql(d: Dialect, docs: str = "documents") -> str:
    """doc_id, page_no, region_no, call_status, body: sound or odd values of the page, wrapped by (doc_id + page_no) % 6."""
    def body(n: int) -> str:
        fields = [f"""'"{k}": ' || {f"json_{k}" if k in PAGES.get(n, ()) else "'null'"}""" for k in KEYS]
        return "'{' || " + " || ', ' || ".join(fields) + " || '}'"

    cases = " ".join(f"WHEN {n} THEN {body(n)}" for n in PAGES)
    fence = "```"
    return f"""
        SELECT doc_id, page_no, region_no, call_status, CASE kind
            WHEN 0 THEN json WHEN 1 THEN '{fence}json' || chr(10) || json || chr(10) || '{fence}' WHEN 2 THEN '{fence}' || chr(10) || json || chr(10) || '{fence}'
            WHEN 3 THEN 'Kết quả: ' || json || ' (hết)' WHEN 4 THEN 'không đọc được trang này' END AS body
        FROM (
            SELECT doc_id, CAST(page_no AS INT) AS page_no, 1 AS region_no, (doc_id + page_no) % 6 AS kind,
                   CASE WHEN (doc_id + page_no) % 6 = 5 THEN 'failed' ELSE 'ok' END AS call_status, CASE page_no {cases} ELSE {body(0)} END AS json
            FROM ({statements_sql(d, docs)}) s {d.generate}) r"""


def box_rows_sql(d: Dialect, docs: str = "documents") -> str:
    """doc_id, page_no, width, height, idx, cls, x1, y1, x2, y2: none to three boxes a page, with equal tops, other classes and corners beyond the page."""
    pages = f"SELECT doc_id, CAST(page_no AS INT) AS page_no FROM {docs} {d.generate}"
    each = "LATERAL VIEW OUTER explode(CASE WHEN n > 0 THEN sequence(0, n - 1) END) b AS idx" if d.spark else "LEFT JOIN LATERAL (SELECT unnest(range(0, n)) AS idx) b ON TRUE"
    return f"""
        SELECT doc_id, page_no, 640 AS width, 480 AS height, CAST(idx AS INT) AS idx,
               CASE WHEN idx IS NULL THEN NULL WHEN (doc_id + page_no + idx) % 3 = 0 THEN 'figure' ELSE 'table' END AS cls,
               CAST((doc_id * 7 + page_no * 13 + idx * 29) % 400 AS DOUBLE) + 0.6 AS x1, CAST((doc_id + page_no * 3 + idx) % 2 * 100 AS DOUBLE) + 0.4 AS y1,
               CAST((doc_id * 7 + page_no * 13 + idx * 29) % 400 + 240 AS DOUBLE) + 0.2 AS x2, CAST((doc_id + idx) % 3 * 90 + 300 AS DOUBLE) + 0.7 AS y2
        FROM (SELECT doc_id, page_no, CAST((doc_id + page_no) % 4 AS INT) AS n FROM ({pages}) p0) q {each}"""


def run_events_sql(d: Dialect) -> str:
    """run_id, seq, kind, name, value of events: stages and counters in quarters, which add up exactly."""
    return """
        SELECT user_id AS run_id, event_id AS seq, CASE event_id % 4 WHEN 1 THEN 'counter' WHEN 2 THEN 'info' ELSE 'stage' END AS kind,
               CASE event_id % 4 WHEN 1 THEN CASE event_id % 3 WHEN 0 THEN 'vlm_calls' ELSE 'parse_failures' END WHEN 2 THEN 'pages_processed'
                    ELSE CASE event_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'vlm' ELSE 'validate' END END AS name,
               CASE event_id % 4 WHEN 1 THEN 1.0E0 WHEN 2 THEN CAST(event_id % 60 AS DOUBLE) ELSE CAST(event_id % 37 AS DOUBLE) / 4.0E0 END AS value
        FROM events"""


def runs_sql(d: Dialect) -> str:
    """run_id, status, total_seconds: error for runs whose last event ends in 7."""
    return f"""
        SELECT run_id, CASE WHEN max(seq) % 10 = 7 THEN 'error' ELSE 'ok' END AS status, sum(CASE WHEN kind = 'stage' THEN value ELSE 0.0E0 END) AS total_seconds
        FROM ({run_events_sql(d)}) e GROUP BY run_id"""


def samples_sql(d: Dialect) -> str:
    """metric, ts, value: two counters of twenty targets, every 15 seconds a sample of one target, each counter reset every 50th one."""
    at = "timestamp_seconds(1704067200 + event_id * 15)" if d.spark else "CAST(to_timestamp(1704067200 + event_id * 15) AT TIME ZONE 'UTC' AS TIMESTAMP)"
    n = f"event_id {d.div} 20 % 50"
    return f"""
        SELECT 'documents_' || CAST(event_id % 20 AS STRING) AS metric, {at} AS ts, CAST({n} AS DOUBLE) AS value FROM events
        UNION ALL SELECT 'errors_' || CAST(event_id % 20 AS STRING), {at}, CAST({n} {d.div} 5 AS DOUBLE) FROM events"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark's side of such SQL; tables that it names are those of sf_dir."""
    for table in ("documents", "events"):
        if f"FROM {table}" in sql or f"JOIN {table}" in sql:
            view = f"{table}_{zlib.crc32(sf_dir.encode()):08x}"
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
            sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {view}", sql)
    return spark.sql(sql)


__all__ = ["DUCK", "FIELDS", "SPARK", "box_rows_sql", "frame", "pages_sql", "responses_sql", "run_events_sql", "runs_sql", "samples_sql", "statements_sql"]
