"""Secret scans by multipart credential linking. DataFrame functions only.

Base matches (assignments, access ids, long hex strings) always stay. Besides them there
are weak parts, which mean little alone, in three roles: identifiers (access ids that are
too short), secrets (assignments whose value is too short, strings that look random, short
hex strings) and endpoints (URLs of any scheme, host fields). An interval join links parts
whose gap is at most SCOPE code points: the parts are dealt to cells of SCOPE code points
and meet the parts of their own and the neighbouring cells. A weak part of any role is
reported only when a part of another role, weak or base, stands in its scope and it does
not overlap a base match. A part that lies inside a URL is no complement of that URL.

Positions come without any UDF: the text between matches and the matches themselves are
two arrays, and the running sums of their lengths are the offsets. The sums are taken in
chunks, so that a text's cost stays in proportion to its matches.

Defined results: a null or empty text has no spans; rows that share an id are scanned row
by row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Base patterns, as the contract has them; letters of the assignment's name in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Weak parts. A secret-like string has upper case, lower case and digits in 20 or more characters, or goes
#: from digits to letters twice in 12 or more; the dot and slash of paths and hosts end it.
_TOKEN = r"[A-Za-z0-9+_=-]"
SECRET = (
    rf"(?<!{_TOKEN})(?:(?=[A-Za-z+_=-]*+[0-9])(?=[0-9a-z+_=-]*+[A-Z])(?=[0-9A-Z+_=-]*+[a-z]){_TOKEN}{{20,}}+"
    rf"|(?=(?:[A-Za-z+_=-]*+[0-9]++[A-Za-z]){{2}}){_TOKEN}{{12,}}+)(?!{_TOKEN})"
)
KEY = r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{12,15}(?![0-9A-Za-z])"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>()]+"""
HOST = r"""(?i:hostname|host|endpoint|server)["']?\x20*[:=]\x20*["']?(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+(?::[0-9]+)?"""
#: Code points between linked parts, at most.
SCOPE = 200
#: Lengths that are summed at a time.
CHUNK = 256

#: Order of kinds in the result; base kinds first, as listed in the contract.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_id", "weak_secret", "endpoint")
#: Kind of the weak parts that are reported.
LINKED = "linked"
#: Role of each kind of part.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "place"}

_SPANS = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """Running sums of an array of ints: within chunks first, then over the chunks."""
    last = lambda xs: F.coalesce(F.get(xs, F.size(xs) - 1), F.lit(0))
    none = F.array().cast("array<int>")
    grown = lambda xs, x: F.array_append(xs, last(xs) + x)

    def chunks(ls):
        numbers = F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / CHUNK).cast("int"))
        return F.transform(numbers, lambda k: F.aggregate(F.slice(ls, k * CHUNK + 1, F.lit(CHUNK)), none, grown))

    def shifted(parts):
        starts = F.aggregate(parts, F.array(F.lit(0)), lambda acc, c: F.array_append(acc, last(acc) + last(c)))
        return _let(starts, lambda at: F.flatten(F.transform(parts, lambda c, k: F.transform(c, lambda x: x + F.get(at, k)))))

    return _let(lengths, lambda ls: F.when(F.size(ls) > 0, _let(chunks(ls), shifted)).otherwise(none))


def matches(text: Column, pattern: str, needle: Column | None = None) -> Column:
    """Array of (start, end, value) of all non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.arrays_zip(found.alias("value"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("before"))

    def placed(ps):
        ends = running_sums(F.transform(ps, lambda p: F.char_length(p["before"]) + F.char_length(p["value"])))
        at = lambda es: F.transform(ps, lambda p, k: F.struct((F.get(es, k) - F.char_length(p["value"])).alias("start"), F.get(es, k).alias("end"), p["value"].alias("value")))
        return _let(ends, at)

    hit = text.rlike(pattern)
    return F.when(hit if needle is None else needle & hit, _let(pairs, placed)).otherwise(F.array().cast(_SPANS))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, and an array of spans for each kind) of each row: the base spans and the weak parts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    named = rows.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        matches(t, ASSIGN).alias("assigns"),
        matches(t, ACCESS, t.contains("AKIA")).alias("ids"),
        # Runs of hex digits are maximal, so a bound on the run drops exactly the runs that are too short.
        matches(t, HEX.replace("+", f"{{{MIN_HEX},}}")).alias("hexes"),
        matches(t, SECRET).alias("secrets"),
        matches(t, KEY).alias("keys"),
        matches(t, ENDPOINT, t.contains("://")).alias("urls"),
        matches(t, HOST).alias("hosts"),
    )
    long_value = lambda m: F.char_length(F.regexp_extract(m["value"], ASSIGN, 2)) >= MIN_ASSIGN
    long_id = lambda m: F.char_length(m["value"]) >= MIN_ACCESS
    of = {
        "assign": F.filter("assigns", long_value),
        "access": F.filter("ids", long_id),
        "hex": F.col("hexes"),
        "weak_id": F.filter("ids", lambda m: ~long_id(m)),
        "weak_secret": F.concat(F.filter("assigns", lambda m: ~long_value(m)), "secrets", "keys"),
        "endpoint": F.concat("urls", "hosts"),
    }
    return named.select("doc_id", "text_hash", *[_spans(of[kind], kind).alias(kind) for kind in KINDS])


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, links): weak parts that have a part of another role in their scope and overlap no base match.

    Cells bound what meets: parts of a kind do not overlap, so a cell holds few of them.
    """
    weak = F.exists(F.array(*[F.size(k) > 0 for k in KINDS if k not in BASE]), lambda x: x)
    role = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in ROLES.items()])
    parts = (
        found.where(weak)
        .select("doc_id", "text_hash", F.explode(F.concat(*KINDS)).alias("p"))
        .select("doc_id", "text_hash", "p.start", "p.end", "p.kind")
        .distinct()
        .withColumn("role", role)
    )
    cell = lambda at: F.floor(at / scope)
    # A part reaches from the cell of its scope's begin to that of its scope's end; a long part touches many cells.
    wide = parts.where(~F.col("kind").isin(*BASE)).withColumn("cell", F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope))))
    others = parts.select(
        "doc_id", "text_hash", *[F.col(c).alias(f"o_{c}") for c in ("start", "end", "kind", "role")], F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell")
    )
    same = wide["doc_id"].eqNullSafe(others["doc_id"]) & (wide["text_hash"] == others["text_hash"]) & (wide["cell"] == others["cell"])
    overlap = (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    near = (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope)
    met = wide.join(others, same & (F.col("role") != F.col("o_role")) & near & ~overlap, "left_semi")
    key = ["doc_id", "text_hash", "start", "end", "kind"]
    candidates = met.select(*key).distinct().withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    base = others.where(F.col("o_kind").isin(*BASE))
    taken = candidates.join(
        base, candidates["doc_id"].eqNullSafe(base["doc_id"]) & (candidates["text_hash"] == base["text_hash"]) & (candidates["cell"] == base["cell"]) & overlap, "left_semi"
    ).select(*key).distinct()
    kept = met.select(*key).distinct().alias("c").join(
        taken.alias("t"),
        F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.text_hash") == F.col("t.text_hash")) & (F.col("c.start") == F.col("t.start")) & (F.col("c.end") == F.col("t.end")) & (F.col("c.kind") == F.col("t.kind")),
        "left_anti",
    )
    return kept.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end", F.lit(LINKED).alias("kind"))).alias("links"))


def _joined(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in (*BASE, LINKED)]), s["kind"])
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, assign, access, hex, links) of each row."""
    found = common.cut(scan(docs))
    weak = linked(found, scope).select(F.col("doc_id").alias("weak_id"), F.col("text_hash").alias("weak_hash"), "links")
    rows = found.join(weak, found["doc_id"].eqNullSafe(weak["weak_id"]) & (found["text_hash"] == weak["weak_hash"]), "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return rows.select("doc_id", *BASE, F.coalesce("links", none).alias("links"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    base = F.concat(*BASE)
    return find(common.table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, "links")).alias("spans"),
    )
