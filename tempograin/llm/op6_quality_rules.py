"""Quality rules and host verdicts, with DataFrame functions only.

Each text is measured and tested by base rules. Failures are counted by host, and each host's rate is shrunk towards
all hosts' by a beta prior fitted to them; a host whose shrunk rate is over HOST_RATE is rejected with all its documents.

Null or empty text: no words, so the base rules reject it. Null host: a host of its own. Empty table: empty result.
Repeated rows count as often as they occur and are all returned. Extra columns stay as they are.
Windows of five words are compared by a 64-bit hash of their words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bind, checkpoint, own_name, written

WINDOW = 5
HOST_RATE = 0.6
#: So many rejected hosts are broadcast at most; rows of a host are dealt to so many tasks beyond that.
BROADCAST_HOSTS, SALTS = 200_000, 64
SYMBOLS = "#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Words of a text that isn't null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def window_hashes(words: Column) -> Column:
    """A hash for each window of five words."""
    n = F.size(words) - (WINDOW - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def covered_words(hashes: Column) -> Column:
    """Words in windows whose hash is there twice or more."""

    def in_sorted(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["hash"] == F.get(pairs, j)["hash"], F.lit(False))
        found = F.filter(F.transform(pairs, lambda p, i: F.when(same(i, i - 1) | same(i, i + 1), p["at"])), lambda at: at.isNotNull())
        return bind(F.sort_array(found), lambda at: F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bind(pairs, in_sorted))


def word_counts(text: Column) -> Column:
    """Struct of n_words and n_repeat_words of one text, which the base rules need."""
    return bind(words_of(F.coalesce(text, F.lit(""))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), bind(window_hashes(w), covered_words).cast("long").alias("n_repeat_words")))


def measures(text: Column) -> Column:
    """Struct of METRICS of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return bind(
        word_counts(text),
        lambda r: F.struct(
            r["n_words"],
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            r["n_repeat_words"],
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def host_verdicts(measured: DataFrame, host: str, failed: str) -> DataFrame:
    """host, n_docs, shrunk_rate, host_rejected. The prior is fitted by the moments of the hosts' rates."""
    hosts = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(f"`{failed}`").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("variance"), F.avg(1 / F.col("n_docs")).alias("noise"))
    # what the rates vary beyond the binomial noise of hosts of these sizes
    spread = F.col("mean") * (1 - F.col("mean"))
    between = F.greatest(F.col("variance") - spread * F.col("noise"), spread * 0.001)
    prior = prior.select("mean", F.when(between > 0, F.greatest(spread / between - 1, F.lit(0.01))).otherwise(F.lit(1.0)).alias("strength"))
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.join(F.broadcast(prior), how="cross").select("host", "n_docs", shrunk.alias("shrunk_rate"), (shrunk > HOST_RATE).alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None, materialise: bool = False) -> tuple[DataFrame, str]:
    """The columns keep of docs (all by default), with one more, whose name is returned: struct of METRICS, base_failed, host_rate, kept.

    materialise: write the measured rows to the checkpoint folder, so that texts are measured once; worth it if keep
    has no large column. Otherwise the two uses, by host and by row, each measure the texts.
    """
    out = own_name(docs, "quality")
    columns = docs.columns if keep is None else keep
    measured = docs.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{host}`").alias(f"{out}_host"), measures(F.col(f"`{text}`")).alias(f"{out}_m"))
    measured = measured.withColumn(f"{out}_failed", base_failed(F.col(f"{out}_m")))
    if materialise:
        measured = checkpoint(measured)
    hosts = host_verdicts(measured, f"{out}_host", f"{out}_failed").select(F.col("host").alias(f"{out}_of"), F.col("shrunk_rate").alias(f"{out}_rate"), F.col("host_rejected").alias(f"{out}_rejected"))
    joined = measured.join(hosts, F.col(f"{out}_host").eqNullSafe(F.col(f"{out}_of")), "left")
    kept = ~F.col(f"{out}_failed") & ~F.coalesce(F.col(f"{out}_rejected"), F.lit(False))
    verdict = F.struct(*(F.col(f"{out}_m")[m].alias(m) for m in METRICS), F.col(f"{out}_failed").alias("base_failed"), F.col(f"{out}_rate").alias("host_rate"), kept.alias("kept"))
    return joined.select(*(measured[f"`{c}`"] for c in columns), verdict.alias(out)), out


def digest(docs: DataFrame) -> DataFrame:
    judged, out = judge(docs.select("doc_id", "text", "source"), keep=["doc_id"], materialise=True)
    return judged.select("doc_id", *(f"{out}.{m}" for m in METRICS), f"{out}.base_failed", f"{out}.kept")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass. Each text is measured once: rows are written with their verdict, from which hosts' counts read two columns.

    Texts aren't shuffled but if more hosts than BROADCAST_HOSTS are rejected; then hosts are salted.
    """
    p = own_name(docs, "quality")
    tested = written(docs.withColumn(p, bind(word_counts(F.col(f"`{text}`")), base_failed)))
    verdicts = host_verdicts(tested, host, p).filter("host_rejected")
    rejected = checkpoint(verdicts.select(F.col("host").alias(p)))
    passed = tested.filter(~F.col(p)).drop(p)
    same = F.col(f"`{host}`").eqNullSafe(F.col(p))
    if rejected.count() <= BROADCAST_HOSTS:
        return passed.join(F.broadcast(rejected), same, "left_anti")
    salted = rejected.withColumn(f"{p}_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return passed.join(salted, same & (F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(SALTS)) == F.col(f"{p}_salt")), "left_anti")


SQL = r"""
with docs as (select doc_id, source, coalesce(text, '') as text from documents),
words as (
  select doc_id, source, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as lines from docs),
windows as (select doc_id, i, w[i:i + 4] as five from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words)),
repeated as (select doc_id, i from windows qualify count(*) over (partition by doc_id, five) > 1),
covered as (select doc_id, count(distinct i + k) as n from repeated, range(0, 5) as r(k) group by doc_id),
m as (
  select doc_id, source, len(w)::bigint as n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words from words left join covered using (doc_id)),
tested as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from m),
hosts as (select source, count(*) as n, sum(base_failed::int) as f from tested group by source),
prior as (select avg(f / n) as mean, coalesce(var_pop(f / n), 0) as variance, avg(1 / n) as noise from hosts),
fitted as (
  select mean, case when between_ > 0 then greatest(mean * (1 - mean) / between_ - 1, 0.01) else 1.0 end as strength
  from (select mean, greatest(variance - mean * (1 - mean) * noise, mean * (1 - mean) * 0.001) as between_ from prior)),
judged as (select source, (f + mean * strength) / (n + strength) > 0.6 as rejected from hosts, fitted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept
from tested join judged on tested.source is not distinct from judged.source
"""
