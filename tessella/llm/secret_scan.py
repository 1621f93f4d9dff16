"""Secret scan with corpus-wide ownership frequency.

Candidates are found per text by pattern. The hash of every candidate is counted
by the distinct repositories and owners that hold it. A value is a widely copied
example if ``shared_from`` owners hold it, or if several owners hold it in
``copied_from`` repositories; otherwise it is taken as live, in however many
repositories a single owner keeps it. Where a table has one column of origin, it
is the repository, and the owner is what ``owner_of`` reads from it.

Only hashes and offsets leave the scan. The counts pre-aggregate by (hash,
owner), so that an example copied into a third of all documents costs one row
per task; the verdicts return by a join on the hash against one row per hash.

A private key in PEM form is its whole block: its span ends with the END line, or
with the base64 text after the header where that line is missing. Its value is
the body without what wraps it, so that one key counts as one value in any layout.

Patterns are linear in the text, however long it is and whatever it repeats: a
web token begins at the first of its marks in a run, and the scheme of an address
counts at most ``SCHEME`` characters.

Edge cases: a header without a body is its own value. A null text counts as
empty. A null repository or owner counts as
one unnamed one. Repeated rows are scanned each on its own, but one owner
counts once. Of spans that begin at the same place all are reported, in the order
of KINDS. An empty table gives no rows. Columns named as the results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, drop_kept, free_names, materialise

# Kinds in their order; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "jwt", "url", "provider")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
PEM_END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: What may stand between the lines of a key: white space, escaped line ends, quotes and marks of comments or quoted mail.
PEM_GAP = r"""(?:[\s"'>#*|,]|\\+[nrt])"""
#: A body that no END line closes: header fields, runs of base64 and a last, shorter run that is no plain word.
PEM_BODY = re.compile(
    rf"(?:{PEM_GAP}*(?:Proc-Type|DEK-Info|Content-Domain):[^\n\\]*)*(?:{PEM_GAP}*[A-Za-z0-9+/]{{16,}}+={{0,2}})+(?:{PEM_GAP}+(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/]+={{0,2}}(?![A-Za-z0-9+/=]))?"
)
_PEM_GAPS = re.compile(PEM_GAP)
# Openings of keys that providers issue, each with what follows: code hosts, chat, maps, payment, mail, package registries, models, clouds.
PROVIDERS = (
    ("ghp_", "[A-Za-z0-9]{36,}"),
    ("gho_", "[A-Za-z0-9]{36,}"),
    ("ghu_", "[A-Za-z0-9]{36,}"),
    ("ghs_", "[A-Za-z0-9]{36,}"),
    ("ghr_", "[A-Za-z0-9]{36,}"),
    ("github_pat_", "[A-Za-z0-9_]{22,}"),
    ("glpat-", "[A-Za-z0-9_-]{20,}"),
    ("xoxb-", "[A-Za-z0-9-]{10,}"),
    ("xoxp-", "[A-Za-z0-9-]{10,}"),
    ("xoxa-", "[A-Za-z0-9-]{10,}"),
    ("xoxr-", "[A-Za-z0-9-]{10,}"),
    ("xoxs-", "[A-Za-z0-9-]{10,}"),
    ("AIza", "[A-Za-z0-9_-]{35}"),
    ("sk_live_", "[A-Za-z0-9]{16,}"),
    ("rk_live_", "[A-Za-z0-9]{16,}"),
    ("sk_test_", "[A-Za-z0-9]{16,}"),
    ("SG.", "[A-Za-z0-9_-]{16,}\\.[A-Za-z0-9_-]{16,}"),
    ("npm_", "[A-Za-z0-9]{36,}"),
    ("pypi-", "[A-Za-z0-9_-]{32,}"),
    ("hf_", "[A-Za-z0-9]{30,}"),
    ("sk-", "[A-Za-z0-9_-]{32,}"),
    ("ya29.", "[A-Za-z0-9_-]{24,}"),
    ("ASIA", "[A-Z0-9]{16,}"),
)
_PROVIDER = re.compile("(?<![A-Za-z0-9_])(?:" + "|".join(re.escape(a) + b for a, b in PROVIDERS) + ")", re.ASCII)
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
#: Most characters of an address's scheme that count.
SCHEME = 32
_SCHEME = re.compile(r"[a-z][a-z0-9+.-]*\Z", re.ASCII)
_LOGIN = re.compile(r"://[^\s:/@]+:([^\s:/@]{6,})@", re.ASCII)


def _web_tokens(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Three runs of base64 joined by dots, the first from its first ``eyJ`` on."""
    at = text.find("eyJ")
    while at >= 0:
        end = _JWT_RUN.match(text, at).end()
        second = _JWT_RUN.match(text, end + 1) if end - at >= 11 and text[end : end + 1] == "." else None
        third = _JWT_RUN.match(text, second.end() + 1) if second and len(second[0]) >= 8 and text[second.end() : second.end() + 1] == "." else None
        if third and len(third[0]) >= 8:
            yield at, 4, third.end(), text[at : third.end()]
            end = third.end()
        at = text.find("eyJ", end)


def _logins(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Addresses with a password."""
    for m in _LOGIN.finditer(text):
        scheme = _SCHEME.search(text[max(0, m.start() - SCHEME) : m.start()])
        if scheme:
            yield m.start() - len(scheme[0]), 5, m.end(), m[1]


def _private_keys(text: str) -> Iterator[tuple[int, int, int, str]]:
    for m in PEM.finditer(text):
        following = text.find("-----BEGIN", m.end())
        close = PEM_END.search(text, m.end(), following if following >= 0 else len(text))
        body = None if close else PEM_BODY.match(text, m.end())
        stop = close.start() if close else body.end() if body else m.end()
        value = _PEM_GAPS.sub("", text[m.end() : stop])
        yield m.start(), 3, close.end() if close else stop, value or m[0]


def find_secrets(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order; offsets in code points, end exclusive.

    Matches of a kind don't overlap: a failing one still takes its characters.
    For access and hex a minimal length in the pattern is the same, as a shorter
    run leaves nothing behind that could match.
    """
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "://" in text:
            out += _logins(text)
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        out += _private_keys(text)
    if "eyJ" in text:
        out += _web_tokens(text)
    if any(opening in text for opening, _ in PROVIDERS):
        out += [(m.start(), 6, m.end(), m[0]) for m in _PROVIDER.finditer(text)]
    out.sort()
    return out


def _joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("kind", T.StringType()),
            T.StructField("hash", T.StringType()),
        ]
    )
)
_SCHEMA = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("found", _FOUND),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch], text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    for batch in batches:
        column, kept = batch.column(text), [batch.column(k) for k in keep]
        cols: dict[str, list] = {f.name: [] for f in _SCHEMA.fields}
        for value in column:
            spans = find_secrets(value.as_py() or "")
            base = [s for s in spans if s[1] < 3]
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                cols[name].append(sum(s[1] == k for s in base))
            cols["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            cols["spans"].append(_joined(spans))
            cols["found"].append([{"start": a, "end": b, "kind": KINDS[k], "hash": hashlib.sha256(v.encode()).hexdigest()} for a, k, b, v in spans])
        kinds = {"found": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.string())]))}
        arrays = [pa.array(v, kinds.get(n, pa.int64() if n.startswith("n_") else pa.string())) for n, v in cols.items()]
        yield pa.RecordBatch.from_arrays(kept + arrays, names=keep + list(cols))


def owner_of(repository: Column) -> Column:
    """Account or host of an origin: ``account`` of account/name, ``host/account`` of an address with more parts, else the host or name."""
    plain = F.regexp_replace(F.lower(repository), r"^[a-z][a-z0-9+.-]*://(?:www\.)?", "")
    parts = F.filter(F.split(plain, "/"), lambda x: x != "")
    return F.when((F.size(parts) > 2) & F.get(parts, F.lit(0)).contains("."), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.get(parts, F.lit(0)))


_RESULT = (*[f.name for f in _SCHEMA.fields], "n_live", "n_shared")


def scan_secrets(
    df: DataFrame,
    repository: str = "source",
    owner: str | None = None,
    shared_from: int = 3,
    copied_from: int = 5,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` + n_assign, n_access, n_hex, base_sha256, spans, found, n_live, n_shared.

    ``found``: array of struct(start, end, kind, hash, owners, repositories, live).
    Without a column ``owner`` owners are read from the repositories.
    """
    keep_cols = [c for c in keep if c.lower() not in _RESULT]
    repo, own, body, row, at, found_, live, shared = free_names(df, "repository", "owner", "body", "row", "at", "judged", "live", "shared")
    narrow = df.select(
        *keep_cols,
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias(repo),
        F.coalesce(F.col(owner).cast("string") if owner else owner_of(F.col(repository).cast("string")), F.lit("")).alias(own),
        F.col(text).alias(body),
    )
    carried = [*keep_cols, repo, own]
    schema = T.StructType([narrow.schema[c] for c in carried] + _SCHEMA.fields)
    scanned = bound_batches(narrow).mapInArrow(lambda it: _scan(it, body, carried), schema).withColumn(row, F.monotonically_increasing_id())
    scanned = materialise(scanned)

    each = scanned.where(F.size("found") > 0).select(F.col(row).alias("at"), F.col(repo).alias("repository"), F.col(own).alias("owner"), F.explode("found").alias("f"))
    by_owner = each.groupBy(F.col("f.hash").alias("hash"), "owner", "repository").agg(F.count("*").alias("n"))
    # Owners and repositories of one hash: a second, small aggregation of the distinct pairs.
    # Written before they are joined: a join with an aggregation below can't be split where a hash is hot.
    owners = materialise(by_owner.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")))
    is_live = ~((F.col("owners") >= shared_from) | ((F.col("owners") > 1) & (F.col("repositories") >= copied_from)))
    judged = (
        each.select("at", "f", F.col("f.hash").alias("hash"))
        .join(owners, "hash")
        .select("at", F.struct("f.start", "f.end", "f.kind", "f.hash", "owners", "repositories", is_live.alias("live")).alias("f"))
    )
    rows = judged.groupBy(F.col("at").alias(at)).agg(
        F.array_sort(F.collect_list("f")).alias(found_), F.count_if(F.col("f.live")).alias(live), F.count_if(~F.col("f.live")).alias(shared)
    )
    empty = F.expr("cast(array() AS array<struct<start:bigint,end:bigint,kind:string,hash:string,owners:bigint,repositories:bigint,live:boolean>>)")
    return scanned.join(rows, F.col(row) == F.col(at), "left").select(
        *keep_cols,
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        "spans",
        F.coalesce(found_, empty).alias("found"),
        F.coalesce(live, F.lit(0)).alias("n_live"),
        F.coalesce(shared, F.lit(0)).alias("n_shared"),
    )


def redact_live(df: DataFrame, mask: str = "[SECRET]", text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` with every live value's span replaced by ``mask``; n_chars, if there, follows the text.

    Spans return to their texts by (id, two text hashes); a text without live spans stays as it is.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    key, other, id_, key_, other_, spans_ = free_names(df, "key", "other", "id2", "key2", "other2", "live_spans")
    keyed = df.withColumns({key: F.xxhash64(whole), other: F.xxhash64(whole, F.lit(1))})
    scanned = scan_secrets(keyed, keep=(id_col, key, other), text=text, **options)
    live = F.transform(F.filter("found", lambda f: f["live"]), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    spans = scanned.where(F.col("n_live") > 0).groupBy(F.col(id_col).alias(id_), F.col(key).alias(key_), F.col(other).alias(other_)).agg(F.first(live).alias(spans_))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key_)) & (F.col(other) == F.col(other_))
    joined = keyed.join(spans.hint("merge"), same, "left")
    # Left to right: text so far, and the offset up to which the source is used.
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    folded = F.aggregate(
        spans_,
        start,
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask)).alias("out"),
                s["end"].alias("at"),
            ),
        ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text))),
    )
    out = joined.withColumn(text, F.when(F.col(spans_).isNotNull(), folded).otherwise(F.col(text)))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans_).isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*df.columns)
