"""The engine's operators as queries over the given tables.

The tables hold no statements, so transactions and documents are derived from
orders and customers: coarse amounts collide on purpose, dates shift by up to
four days, and every fifth document has no vendor, so every branch is reached.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Locale, Source
from millrace.functions import locale as loc
from millrace.functions import text as tx
from millrace.functions.fuzzy import fuzzy_score
from millrace.operators import ledger as lg
from millrace.operators import matching as mt
from millrace.operators import statements as st
from millrace.operators.archive import archive_plan
from millrace.sources.files import classify, route

FRENCH = Locale()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, k, dt, descr, amt, status: what all derived relations start from."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        F.col("c_mktsegment").alias("account"), F.col("o_orderkey").cast("bigint").alias("k"), F.to_date("o_orderdate").alias("dt"),
        F.concat_ws(" ", "o_orderpriority", "c_name").alias("descr"), (F.floor(F.col("o_totalprice") / 4000) * 40).cast("decimal(18,2)").alias("amt"), F.col("o_orderstatus").alias("status"),
    )


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions whose id is the order's key as text; occurrence 0."""
    s = sales(spark, sf_dir)
    return s.select("account", F.col("k").cast("string").alias("txn_id"), F.lit(0).alias("occurrence"), F.col("dt").alias("date"), F.col("descr").alias("description"), F.col("amt").alias("amount"), F.col("k").alias("seq"), F.when(F.col("status") != "P", F.col("amt")).alias("debit"), F.when(F.col("status") == "P", F.col("amt")).alias("credit"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).where("k % 7 = 0")
    return s.select(
        F.concat(F.lit("doc-"), F.lpad(F.col("k").cast("string"), 10, "0"), F.lit(".pdf")).alias("source_path"), F.col("amt").alias("amount"),
        F.when(F.col("k") % 35 != 0, F.date_add("dt", (F.col("k") % 9 - 4).cast("int"))).alias("date"), F.when(F.col("k") % 5 != 0, F.col("descr")).alias("vendor"), (F.col("k") % 11 == 0).alias("needs_ocr"), F.col("k").alias("doc_ord"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement rows as text: French dates and amounts, some broken in each of four ways."""
    s = sales(spark, sf_dir)
    money = F.replace(F.col("amt").cast("string"), F.lit("."), F.lit(","))
    k = F.col("k")
    debit = F.when(k % 50 == 1, F.lit("12,3x")).when(k % 50 == 3, F.lit("")).when(F.col("status") != "P", F.concat(F.lit("\u00a0"), money)).otherwise(F.lit(""))
    credit = F.when(k % 50 == 2, F.lit("--")).when(k % 50 == 3, F.lit(" ")).when(F.col("status") == "P", money).otherwise(F.lit(""))
    date = F.when(k % 50 == 0, F.lit("31/02/2026")).otherwise(F.date_format("dt", "d/M/yyyy"))
    return s.select("account", "k", F.col("account").alias("source_file"), F.col("k").alias("line_no"), date.alias("raw_date"), F.col("descr").alias("raw_description"), debit.alias("raw_debit"), credit.alias("raw_credit"))


# ---------------------------------------------------------------- scalar functions


def parse_amount_fr(spark, sf_dir):
    k = F.col("k")
    grouped = F.replace(F.format_number(k * 13, 0), F.lit(","), F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit("\u00a0")))
    text = F.concat(F.when(k % 10 == 1, F.lit(" -")).otherwise(F.lit("")), grouped, F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"), F.when(k % 10 == 0, F.lit("e5")).otherwise(F.lit("")))
    return sales(spark, sf_dir).select("k", F.abs(loc.parse_amount(text, FRENCH)).cast("decimal(18,2)").alias("amount"))


def parse_date_fr(spark, sf_dir):
    s = sales(spark, sf_dir)
    text = F.when(F.col("k") % 10 == 0, F.lit("31/02/2026")).when(F.col("k") % 10 == 1, F.date_format("dt", "d/M/yyyy")).when(F.col("k") % 10 == 2, F.date_format("dt", "yyyy-MM-dd")).otherwise(F.concat(F.lit(" "), F.date_format("dt", "dd/MM/yyyy")))
    return s.select("k", loc.parse_date(text, FRENCH).alias("date"))


def amount_texts(spark, sf_dir):
    s = sales(spark, sf_dir)
    text = F.concat(F.when(F.col("k") % 3 == 0, F.lit("-00")).otherwise(F.lit("")), F.replace(F.col("amt").cast("string"), F.lit("."), F.lit(",")))
    return s.select("k", loc.amount_text(text, FRENCH).alias("amount_text"))


def normalize_description(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_description(F.col("text")).alias("description"))


def transaction_id(spark, sf_dir):
    s = sales(spark, sf_dir)
    return s.select("k", tx.transaction_id(F.col("account"), F.col("dt"), F.col("amt").cast("string"), tx.normalize_description(F.col("descr"))).alias("txn_id"))


def fuzzy_scores(spark, sf_dir):
    """The score of each customer's segment and name against a nation's name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("a"))
    s = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(" ", "n_name", F.lit("Customer")).alias("b"))
    j = c.join(F.broadcast(s), F.col("c_custkey") % 25 == F.col("n_nationkey"))  # nation: 25 rows
    return j.select("c_custkey", F.round(fuzzy_score(F.col("a"), F.col("b")), 6).alias("score"))


# ---------------------------------------------------------------- files and documents


def _paths(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".csv", ".PDF", ".png", ".jpeg", ".txt", ".tiff", ""))), (k % 7 + 1).cast("int"))
    folder = F.element_at(F.array(*(F.lit(x) for x in ("statements/SG/2026", "statements", "Documents_2026/x", "inbox"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("/"), F.col("source"), F.lit("_"), k.cast("string"), suffix).alias("path"))


RULES = (Source("main", "csv", "statements/SG/**/*.csv"), Source("second", "csv", "*src1*.csv"), Source("paper", "pdf", "Documents_*.[pP]DF"), Source("never", "csv", None), Source("rest", "csv", "inbox/src?_[!1]*.csv"))


def route_files(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("doc_id", route(F.col("path"), RULES).cast("bigint").alias("rule_idx"))


def classify_files(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("doc_id", classify(F.col("path"), route(F.col("path"), RULES)).alias("class"))


def _document_text() -> Column:
    """A text with an amount and a date, or parts of them, before the document's own, whole text."""
    k = F.col("doc_id")
    amount = F.concat((k % 2500).cast("string"), F.when(k % 2 == 0, F.lit(",")).otherwise(F.lit(".")), F.lpad((k % 100).cast("string"), 2, "0"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 700).cast("int"))
    date = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "dd/MM/yyyy")).when(k % 4 == 2, F.date_format(day, "dd-MM-yyyy")).otherwise(F.lit("99/99/2024"))
    first = F.when(k % 5 == 0, F.lit("2D-DOC12")).when(k % 5 == 1, F.lit("REF 992026-06-1512 é01/02/20245")).otherwise(F.lit("2D-DOC"))
    return F.concat(first, F.lit("\n \n"), F.element_at(F.array(F.lit("Total: "), F.lit("1234567"), F.lit("ab")), (k % 3 + 1).cast("int")), F.lit("\n"), F.lit("Montant "), amount, F.lit(" EUR\nDate "), date, F.lit("\n"), F.coalesce("text", F.lit("")))


def doc_extract_amount(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.extract_amount(_document_text()).alias("amount"))


def doc_extract_date(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.extract_date(_document_text()).alias("date"))


def doc_vendor(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.extract_vendor(_document_text()).alias("vendor"))


# Month names as they stand on bills, one that isn't a month among them.
BILL_MONTHS = ["janvier", "févr.", "mars", "avril", "mai", "juin", "juillet", "août", "sept.", "octobre", "nov.", "décembre", "brumaire"]


def prelevement_features(spark, sf_dir):
    k = F.col("k")
    month = F.element_at(F.array(*(F.lit(m) for m in BILL_MONTHS)), (k % 13 + 1).cast("int"))
    text = F.concat(F.lit("Facture 12,00\nSera prélevé "), F.when(k % 2 == 0, F.lit("sur ")).otherwise(F.lit("")), F.lit("le "), (k % 31 + 1).cast("string"), F.lit(" "), month, F.lit(" 2025 "), F.replace(F.col("amt").cast("string"), F.lit("."), F.lit(",")), F.lit(" EUR"))
    date, amount = tx.debit_line(text)
    return sales(spark, sf_dir).select("k", date.alias("debit_date"), amount.alias("debit_amount"))


def document_features(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.features(_document_text(), F.lit(False)).alias("f"))
    return d.select("doc_id", "f.*")


# ---------------------------------------------------------------- statements


def parse_failures(spark, sf_dir):
    return st.validated(raw(spark, sf_dir), FRENCH).where("reason is not null").select("k", "reason")


def statement_rows(spark, sf_dir):
    good, _ = st.split(st.validated(raw(spark, sf_dir), FRENCH))
    money = lambda c: F.col(c).cast("decimal(18,2)").alias(c)
    return good.select("k", "date", "description", money("debit"), money("credit"), money("amount"), "txn_id", F.col("occurrence").cast("bigint").alias("occurrence"))


def occurrence_index(spark, sf_dir):
    """Occurrences within a customer segment of equal (date, amount)."""
    s = sales(spark, sf_dir).select("k", F.col("account").alias("source_file"), F.concat_ws("|", F.date_format("dt", "yyyy-MM-dd"), F.col("amt").cast("string")).alias("txn_id"))
    return st.with_occurrence(s, "source_file", "k").select("k", F.col("occurrence").cast("bigint").alias("occurrence"))


def word_table(spark, sf_dir) -> DataFrame:
    """A statement page for each 20 parts: a header, and for each part a dated line and a continuation."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"), "p_name")
    p = p.select("k", F.element_at(F.split("p_name", " "), 1).alias("a"), (F.col("k") / 100).cast("bigint").alias("f"), F.floor(F.col("k") % 100 / 20).cast("int").alias("page"), (F.col("k") % 20).alias("i"))
    file = F.concat(F.lit("f"), F.col("f").cast("string"))
    y = F.col("i") * 30.0 + 50
    x = F.when(F.col("k") % 2 == 0, 450.0).otherwise(520.0)
    word = lambda o, t, x0, top: F.struct(F.lit(o).alias("o"), t.alias("text"), x0.cast("double").alias("x0"), (x0 + 30).cast("double").alias("x1"), top.cast("double").alias("top"))
    date = F.concat(F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"), F.lit("/03/2026"))
    body = F.array(
        word(10, date, F.lit(20.0), y), word(11, date, F.lit(60.0), y + 1), word(12, F.col("a"), F.lit(120.0), y + 2.5), word(13, F.concat(F.lit("N"), F.col("k").cast("string")), F.lit(180.0), y - 0.0),
        word(14, F.concat((F.col("k") % 900).cast("string"), F.lit(",50"), F.when(F.col("k") % 3 == 0, F.lit("*")).otherwise(F.lit(""))), x, y), word(15, F.lit("suite"), F.lit(130.0), y + 12), word(16, F.concat(F.lit("R"), F.col("k").cast("string")), F.lit(170.0), y + 13),
    )
    rows = p.select(file.alias("file"), "page", (F.col("i") * 10).alias("o0"), F.explode(body).alias("w"))
    head = p.select(file.alias("file"), "page").distinct().select("file", "page", F.lit(-100).alias("o0"), F.explode(F.array(word(1, F.lit("Débit"), F.lit(440.0), F.lit(10.0)), word(2, F.lit("Crédit"), F.lit(510.0), F.lit(10.0)))).alias("w"))
    return rows.unionByName(head).select("file", "page", (F.col("o0") + F.col("w.o")).alias("word_ord"), "w.text", "w.x0", "w.x1", "w.top")


def pdf_lines_to_txns(spark, sf_dir):
    r = st.positional_rows(word_table(spark, sf_dir))
    return r.select("file", F.col("line_no").cast("bigint").alias("line_no"), "raw_date", "raw_description", "raw_debit", "raw_credit")


# ---------------------------------------------------------------- matching


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("account", F.col("seq").alias("txn"), F.col("doc_ord").alias("doc"))


def candidates_exact(spark, sf_dir):
    return _pairs(mt.candidates(txns(spark, sf_dir), docs(spark, sf_dir)))


def candidates_tolerance(spark, sf_dir):
    return _pairs(mt.candidates(txns(spark, sf_dir), docs(spark, sf_dir), Decimal(40)))


def _outcome(spark, sf_dir, tolerance=0, reuse=False) -> mt.Outcome:
    return mt.match(txns(spark, sf_dir), docs(spark, sf_dir), tolerance, reuse=reuse)


def match_links(spark, sf_dir):
    return _outcome(spark, sf_dir).links.select("account", "txn_id", "source_path", F.round("confidence", 6).alias("confidence"))


def match_links_tolerance(spark, sf_dir):
    return _outcome(spark, sf_dir, Decimal(40)).links.select("account", "txn_id", "source_path", F.round("confidence", 6).alias("confidence"))


def match_unmatched(spark, sf_dir):
    return _outcome(spark, sf_dir).unmatched.select("account", "txn_id")


def match_ambiguous(spark, sf_dir):
    return _outcome(spark, sf_dir).ambiguous.select("account", "source_path")


def match_unmatchable(spark, sf_dir):
    return _outcome(spark, sf_dir).unmatchable.select("account", "source_path", F.col("section").cast("bigint").alias("section"))


def review_items(spark, sf_dir):
    return mt.review_items(_outcome(spark, sf_dir, reuse=True)).select("account", F.col("section").cast("bigint").alias("section"), "seq", "reason")


# ---------------------------------------------------------------- ledger, archive, report


def _ledger(spark, sf_dir) -> DataFrame:
    return lg.as_ledger(txns(spark, sf_dir).where("seq % 3 = 0"), F.lit("2026-01-01T00:00:00"))


def ledger_upsert(spark, sf_dir):
    """Rows added to a ledger that holds every third transaction, when every fifth comes twice."""
    t = txns(spark, sf_dir)
    twice = t.unionByName(t.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 10_000_000_000))
    added = lg.as_ledger(lg.new_rows(_ledger(spark, sf_dir), twice), F.lit("2026-01-02T00:00:00"))
    return added.select("account", "txn_id", "date", "description", "debit", "credit", "month", "imported_at", "seq")


def ledger_set_match(spark, sf_dir):
    links = _outcome(spark, sf_dir).links.select(*lg.KEY, F.col("source_path").alias("archived_path"), "confidence")
    out = lg.set_match(_ledger(spark, sf_dir), links)
    return out.select("account", "txn_id", "document", "match_status", F.round("confidence", 6).alias("confidence"))


def ledger_migrate(spark, sf_dir):
    t = txns(spark, sf_dir)
    old = t.select(F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("description").alias("Description"), F.col("amount").alias("Debit"), F.when(F.col("seq") % 2 == 0, F.lit(" ")).otherwise(F.lit("2")).alias("Occurrence"), F.col("txn_id").alias("Transaction ID"), F.lit("x").alias("Source File"))
    new = lg.migrate(old)
    return new.select(*(F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in new.columns))


def ledger_month_summary(spark, sf_dir):
    s = lg.month_summary(txns(spark, sf_dir))
    return s.select("account", "month", "n_rows", F.col("debit").cast("decimal(18,2)").alias("debit"), F.col("credit").cast("decimal(18,2)").alias("credit"))


def archive_paths(spark, sf_dir):
    d = docs(spark, sf_dir)
    plan = archive_plan(d.withColumn("suffix", F.lit(".pdf")).withColumn("content_md5", F.md5(F.concat_ws("|", (F.col("doc_ord") % 6).cast("string")).cast("binary"))), "archive")
    return plan.select("doc_ord", "target", "copied")


def archive_paths_again(spark, sf_dir):
    """The plan when the archive holds a third of the documents' files: some with the same content, some with another, some under a numbered name."""
    d = docs(spark, sf_dir).withColumn("suffix", F.lit(".pdf")).withColumn("content_md5", F.md5((F.col("doc_ord") % 6).cast("string").cast("binary")))
    name = F.concat_ws("/", tx.archive_dir("archive", F.col("date")), tx.archive_name(F.col("date"), F.col("amount"), F.col("vendor"), F.col("suffix")))
    k = F.col("doc_ord")
    there = d.where(k % 3 == 0).select(tx.numbered_name(name, F.when(k % 2 == 0, 0).otherwise(1 + k % 2)).alias("target"), F.md5((k % 4).cast("string").cast("binary")).alias("content_md5")).groupBy("target").agg(F.min("content_md5").alias("content_md5"))
    return archive_plan(d, "archive", existing=there).select("doc_ord", "target", "copied")


def run_report(spark, sf_dir):
    """The counters of a run over all transactions and documents, a third of them in the ledger already."""
    t, out = txns(spark, sf_dir), _outcome(spark, sf_dir, reuse=True)
    counts = [
        lg.new_rows(_ledger(spark, sf_dir), t).agg(F.count("*").alias("rows_added")), out.links.agg(F.count("*").alias("docs_matched")),
        mt.review_items(out).agg(F.count("*").alias("review_items")), st.validated(raw(spark, sf_dir), FRENCH).where("reason is not null").agg(F.count("*").alias("parse_failures")),
    ]
    one = counts[0]
    for c in counts[1:]:
        one = one.crossJoin(c)  # each is one row
    return one.withColumn("rows_updated", F.lit(0).cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        parse_amount_fr, parse_date_fr, amount_texts, normalize_description, transaction_id, fuzzy_scores, route_files, classify_files, doc_extract_amount, doc_extract_date, doc_vendor,
        prelevement_features, document_features, parse_failures, statement_rows, occurrence_index, pdf_lines_to_txns, candidates_exact, candidates_tolerance, match_links, match_links_tolerance,
        match_unmatched, match_ambiguous, match_unmatchable, review_items, ledger_upsert, ledger_set_match, ledger_migrate, ledger_month_summary, archive_paths, archive_paths_again, run_report,
    )
}
