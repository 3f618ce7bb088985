"""Quality rules by document and by host, in DataFrame functions only.

Document rules are computed with array functions inside the row: the base rule (too short, or mostly
repeated words), too many symbols, too many repeated lines, and words too short or too long on average.
The failures of each rule are then counted by host; each host's failure rate is shrunk with the rule's
own beta prior, whose two parameters come from the mean and variance of the rates of all hosts (method
of moments); a host with a shrunk rate over `max_rate` under any rule is rejected with all its documents.
A document that fails another rule than the base one goes only with its host.

Edge cases: a null text has no words, so it fails the base rule; a null host is a host of its own;
ties do not arise; repeated rows count as often as they occur; very long texts are sorted inside
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Beyond so many hosts the verdicts are joined by shuffle; up to it they are a small table.
BROADCAST_HOSTS = 100_000
#: Whether a document fails a rule, from the columns of `document_rules`.
RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = docs.withColumn("_body", body)
    step = step.withColumn("_words", F.filter(F.split("_body", SPACE), lambda w: w != ""))
    step = step.withColumn("_lines", F.filter(F.split("_body", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    step = step.withColumn("_n", F.size("_words"))
    grams = F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.struct(F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("g"), i.alias("p"))))
    step = step.withColumn("_grams", F.array_sort(F.coalesce(grams, F.array().cast("array<struct<g:string,p:int>>"))))
    same = lambda x, i: F.coalesce(x["g"] == F.get("_grams", i)["g"], F.lit(False))
    step = step.withColumn("_at", F.sort_array(F.transform(F.filter("_grams", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return (
        step.withColumn("n_words", F.col("_n").cast("long"))
        .withColumn("word_chars", F.length(F.translate("_body", " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length("_body") - F.length(F.translate("_body", SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", covered)
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_body", "_words", "_lines", "_n", "_grams", "_at")
    )


def host_verdicts(rules: DataFrame, host: str = "host", max_rate: float = 0.5) -> DataFrame:
    """Per host: documents, failures and shrunk rate of each rule, and verdict. One row per host; counts
    are combined before the shuffle, so a hot host costs no more than others."""
    failures = [F.count_if(F.expr(failed)).alias(f"failed_{r}") for r, failed in RULES.items()]
    hosts = rules.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), *failures)
    rate = {r: F.col(f"failed_{r}") / F.col("host_docs") for r in RULES}
    moments = hosts.agg(*[f(x).alias(f"{n}_{r}") for r, x in rate.items() for n, f in (("m", F.avg), ("v", F.var_pop))])

    def weight(m: Column, v: Column) -> Column:
        # Method of moments: a + b = m (1 - m) / v - 1, held between 2 and 1000 documents' weight.
        return F.when(v > 0, F.least(F.lit(1000.0), F.greatest(F.lit(2.0), m * (1 - m) / v - 1))).otherwise(F.lit(1000.0))

    prior = moments.select(*[F.col(f"m_{r}") for r in RULES], *[weight(F.col(f"m_{r}"), F.col(f"v_{r}")).alias(f"w_{r}") for r in RULES])
    shrunk = {r: (F.col(f"failed_{r}") + F.col(f"m_{r}") * F.col(f"w_{r}")) / (F.col("host_docs") + F.col(f"w_{r}")) for r in RULES}
    # The prior is a single row.
    both = hosts.join(F.broadcast(prior)).select(host, "host_docs", *[f"failed_{r}" for r in RULES], *[x.alias(f"rate_{r}") for r, x in shrunk.items()])
    return both.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_rate)


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5, salts: int = 32) -> DataFrame:
    """docs (doc_id, text, host column) -> one row per document with rules, host verdict and kept.
    The host table is broadcast only after its size was checked; beyond the bound it is joined on
    (host, salt), its rows repeated once per salt, so that a hot host spreads over tasks."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.coalesce(docs[host].cast("string"), F.lit("\x00")).alias("host"))
    # A few numbers a document: written once, read for the host counts and for the result.
    rules = materialize(document_rules(rows).drop("text"), "rules")
    verdicts = host_verdicts(rules, "host", max_rate)
    n_hosts = rules.select(F.approx_count_distinct("host")).first()[0]
    if n_hosts <= BROADCAST_HOSTS:
        joined = rules.join(F.broadcast(verdicts), "host", "left")
    else:
        salted = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rules.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    out = judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "host_docs", *[f"failed_{r}" for r in RULES], "host_rejected")


OP8_SQL = """
with d as (select doc_id, coalesce(text, '') t, coalesce(source, chr(1)) host, row_number() over () rid from documents),
w as (select *, [x for x in string_split_regex(t, '[\\x20\\x09-\\x0D]+') if x <> ''] ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] ls from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w)),
t3 as (select rid, i from g qualify count(*) over (partition by rid, g) > 1),
c as (select rid, count(distinct i + k) n from t3, range(3) t(k) group by rid),
b as (select w.doc_id, w.host, w.rid, len(ws)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words
 from w left join c on c.rid = w.rid),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from b),
k as (select host, count(*) host_docs, count_if(base_failed)::bigint failed_base, count_if(10 * n_symbols > word_chars)::bigint failed_symbols,
 count_if(10 * n_dup_lines > 3 * n_lines)::bigint failed_lines, count_if(word_chars < 2 * n_words or word_chars > 15 * n_words)::bigint failed_length from f group by host),
r as (select host, host_docs, rule, failed from k unpivot (failed for rule in (failed_base, failed_symbols, failed_lines, failed_length))),
p as (select rule, avg(failed / host_docs) m, coalesce(var_pop(failed / host_docs), 0) v from r group by rule),
q as (select rule, m, case when v > 0 then least(1000, greatest(2, m * (1 - m) / v - 1)) else 1000 end w from p),
x as (select host, bool_or((failed + m * w) / (host_docs + w) > 0.5) host_rejected from r join q using (rule) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_rejected kept,
 n_lines, host_docs, failed_base, failed_symbols, failed_lines, failed_length, host_rejected
from f join k using (host) join x using (host)
"""
