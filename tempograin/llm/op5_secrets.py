"""Secret scanning with corpus-wide ownership frequency, with DataFrame functions only.

Base candidates are found by three patterns; generic ones are long tokens that mix cases and digits. The hash of each
candidate's value is counted over distinct owners (by default a document's source), repositories (its source and language) and
documents: a value that several owners hold is a copied example, one that a single owner holds is live-looking, in however many
repositories or copies. Live-looking generic tokens are added to the base spans.

Null or empty text: no spans. A null owner is an owner of its own, and so is a repository with a null part. Empty table: empty
result. Repeated rows are all returned and count once. Spans are code points, end exclusive; kinds sort as in KINDS. Texts may be
of any length. Columns other than those named are left out of the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, checkpoint, own_name

#: (kind, pattern, group whose value is the secret); each candidate must also pass passes().
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
    ("access", r"AKIA[A-Z0-9]+", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
    ("other", r"(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{24,}", 0),
)
KINDS = tuple(k for k, _, _ in PATTERNS)
#: Live-looking: held by at most so many owners.
LIVE_OWNERS = 1


def passes(kind: str, value: Column) -> Column:
    if kind == "other":
        of = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
        return (of("[^A-Z]+") >= 4) & (of("[^a-z]+") >= 4) & (of("[^0-9]+") >= 4)
    return F.length(value) >= {"assign": 6, "access": 20, "hex": 24}[kind]


def running_starts(gaps: Column, matches: Column) -> Column:
    """The start of each match, from the lengths of the gaps before the matches and of the matches. Sums go by chunks, whose size is the root of the count."""
    steps = F.transform(matches, lambda m, i: F.struct(F.get(gaps, i).alias("gap"), m.alias("len")))

    def sums(steps: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(steps))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / size).cast("int")), lambda j: F.slice(steps, j * size + 1, size))
        whole = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["gap"] + s["len"])
        heads = lambda cs: F.aggregate(cs, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + whole(c))))
        inside = lambda c, head: F.aggregate(
            c, F.struct(head.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, s: F.struct((a["at"] + s["gap"] + s["len"]).alias("at"), F.concat(a["out"], F.array(a["at"] + s["gap"])).alias("out")), lambda a: a["out"]
        )
        return bind(chunks, lambda cs: bind(heads(cs), lambda hs: F.flatten(F.transform(cs, lambda c, j: inside(c, F.get(hs, j))))))

    return bind(steps, sums)


def spans_of(text: Column, kind: str, pattern: str, group: int) -> Column:
    """array<struct<start, kind_at, end, value>> of one pattern's candidates that pass."""
    regex = F.lit(pattern)
    empty = F.array().cast("array<struct<start:int,kind_at:int,end:int,value:string>>")

    def located(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        values = F.regexp_extract_all(text, regex, F.lit(group)) if group else found
        # starts hold only if split and regexp_extract_all agree on the matches, which both take leftmost and non-overlapping
        starts = bind(gaps, lambda g: running_starts(g, F.transform(found, F.length)))
        rows = bind(starts, lambda at: bind(values, lambda vs: F.transform(found, lambda m, i: F.struct(F.get(at, i).alias("start"), F.lit(KINDS.index(kind)).alias("kind_at"), (F.get(at, i) + F.length(m)).alias("end"), F.get(vs, i).alias("value")))))
        return F.filter(rows, lambda s: passes(kind, s["value"]))

    return bind(F.regexp_extract_all(text, regex, F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(located(found)))


def in_words(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kind, s["kind_at"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), document: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs, row, owner, repository, document (hashes of both) and secrets: array<struct<start, kind_at, end, hash>> of all candidates; found once and written to the checkpoint folder."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.concat(*(spans_of(whole, *p) for p in PATTERNS))
    hashed = F.transform(found, lambda s: F.struct(s["start"], s["kind_at"], s["end"], F.unhex(F.sha2(s["value"], 256)).alias("hash")))
    # a null is told from every value
    hash_of = lambda *names: F.xxhash64(*(x for n in names for x in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())))
    held = (F.monotonically_increasing_id().alias("row"), hash_of(owner).alias("owner"), hash_of(*repository).alias("repository"), hash_of(document).alias("document"), hashed.alias("secrets"))
    own = [own_name(docs.select(*(F.col(f"`{c}`") for c in keep)), n) for n in ("row", "owner", "repository", "document", "secrets")]
    made = docs.select(*(F.col(f"`{c}`") for c in keep), *(x.alias(n) for x, n in zip(held, own, strict=True)))
    return checkpoint(made).withColumnsRenamed(dict(zip(own, ("row", "owner", "repository", "document", "secrets"), strict=True)))


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories, n_documents, live. Each is made distinct before it meets by hash, so a value that a third of all documents hold is counted by many tasks."""
    held = scanned.select("owner", "repository", "document", F.explode("secrets.hash").alias("hash"))
    counted = held.groupBy("hash").agg(*(F.count_distinct(c).alias(f"n_{n}") for c, n in (("owner", "owners"), ("repository", "repositories"), ("document", "documents"))))
    return counted.withColumn("live", F.col("n_owners") <= LIVE_OWNERS)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; n_live and n_copied of the base spans; the most repositories that hold one of the document's values."""
    repository = tuple(c for c in ("source", "lang") if c in docs.columns)
    scanned = scan(docs.select("doc_id", "text", *repository), repository=repository)
    each = scanned.select("row", F.explode("secrets").alias("s")).select("row", "s", F.col("s.hash").alias("hash"))
    judged = each.join(ownership(scanned), "hash")
    base = lambda s: s["kind_at"] < KINDS.index("other")
    added = judged.filter(~base(F.col("s")) & F.col("live"))
    counted = judged.groupBy("row").agg(F.sum((base(F.col("s")) & F.col("live")).cast("long")).alias("n_live"), F.sum((base(F.col("s")) & ~F.col("live")).cast("long")).alias("n_copied"), F.max("n_repositories").alias("max_repositories"))
    extra = added.groupBy("row").agg(F.collect_list(F.struct("s.start", "s.kind_at", "s.end")).alias("added"))
    short = F.transform(F.filter("secrets", base), lambda s: F.struct(s["start"], s["kind_at"], s["end"]))
    rows = scanned.select("doc_id", "row", short.alias("base")).join(counted, "row", "left").join(extra, "row", "left")
    free = F.filter(F.coalesce("added", F.array().cast("array<struct<start:int,kind_at:int,end:int>>")), lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    n_of = lambda k: F.size(F.filter("base", lambda s: s["kind_at"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id", *(n_of(k) for k in KINDS[:3]), F.sha2(in_words(F.col("base")), 256).alias("base_sha256"), in_words(F.concat("base", free)).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"), F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
        F.coalesce("max_repositories", F.lit(0).cast("long")).alias("max_repositories"),
    )
