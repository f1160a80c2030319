"""Secret scans with multipart credential linking, in built-in functions only.

Strong findings (assignments, access identifiers, long hex runs) are reported wherever they stand.
Weak ones - an opaque string, a login name, an endpoint - are reported only where complementary
parts co-occur: an opaque string with both an identifier (access identifier or login name) and an
endpoint within ``SCOPE`` code points of it. The parts meet in an interval join on (document,
stretch of text), so pairs are formed only inside a scope, and their number is bounded by its length.

Most documents hold no opaque string; they are finished in one pass without shuffle. Only the rest
is written to the shared folder and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import stored

# Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "opaque", "ident", "endpoint")
ASSIGN, ACCESS, HEX, OPAQUE, IDENT, ENDPOINT = range(len(KINDS))
SCOPE = 200
STRETCH = 512


def _either_case(*words: str) -> str:
    """Letters in either case, spelled out: case folding differs between regex engines."""
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)


_KEYWORDS = _either_case("password", "passwd", "secret", "token", "api_?key")
_SIGN = r"[\"']?\x20*[:=]\x20*[\"']?"
# Per kind: the pattern, and the group whose length decides with its least length.
PATTERNS = {
    ASSIGN: (rf"(?:{_KEYWORDS}){_SIGN}([A-Za-z0-9+/_.=-]+)", 1, 6),
    ACCESS: (r"AKIA[A-Z0-9]+", 0, 20),
    HEX: (r"[0-9a-f]{24,}", 0, 24),
    OPAQUE: (r"[A-Za-z0-9+/_-]{32,}", 0, 32),
    IDENT: (rf"(?:{_either_case('username', 'user', 'login', 'client_?id', 'account')}){_SIGN}([A-Za-z0-9_.@-]+)", 1, 3),
    ENDPOINT: (r"[a-z]{2,16}://[^\x20\x09-\x0D\"'<>]+|(?<![a-z0-9.-])(?:[a-z0-9-]{1,63}\.)+(?:com|net|org|io|local|internal)", 0, 6),
}
_TEXT = "coalesce(text, '')"
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _quoted(pattern: str) -> str:
    return "r\"" + pattern.replace('\\"', "\\x22").replace('"', "\\x22") + "\""


def spans_sql(kind: int, text: str = _TEXT) -> str:
    """SQL of the accepted matches of ``kind``, leftmost first, in code points.

    Matches come from ``regexp_extract_all``; where they start follows from the lengths of what
    ``split`` leaves between them.
    """
    pattern, group, least = PATTERNS[kind]
    p = _quoted(pattern)
    step = (
        f"named_struct('at', a.at + length(get(g, i)) + length(get(m, i)), 'out', "
        f"case when length(get(v, i)) >= {least} then concat(a.out, array(named_struct('start', a.at + length(get(g, i)), "
        f"'kind', {kind}, 'end', a.at + length(get(g, i)) + length(get(m, i))))) else a.out end)"
    )
    walk = f"aggregate(sequence(0, size(m) - 1), named_struct('at', 0, 'out', cast(array() as {_SPANS})), (a, i) -> {step}, a -> a.out)"
    for name, value in (
        ("v", f"regexp_extract_all({text}, {p}, {group})"),
        ("m", f"regexp_extract_all({text}, {p}, 0)"),
        ("g", f"split({text}, {p}, -1)"),
    ):
        walk = f"get(transform(array({value}), {name} -> {walk}), 0)"
    return f"case when {text} rlike {p} then {walk} else cast(array() as {_SPANS}) end"


def spans_text(spans: str) -> str:
    """SQL that prints a sorted span list as kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(get(array({names}), x.kind), ':', x.start, ':', x.end)), ',')"


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (start, kind number, end; sorted by start and kind).

    A null or empty text has no span. Rows are looked at one by one: a repeated id or text gets its
    own result. Columns of the input with these names are replaced; all others stay.
    """
    docs = docs.drop("base_spans", "spans")
    columns = [f"`{c}`" for c in docs.columns]
    base = f"sort_array(concat({', '.join(spans_sql(k) for k in (ASSIGN, ACCESS, HEX))}))"

    def has(kind):
        return f"{_TEXT} rlike {_quoted(PATTERNS[kind][0])}"

    linkable = f"({has(OPAQUE)} and {has(ENDPOINT)} and ({has(ACCESS)} or {has(IDENT)}))"
    plain = docs.where(f"not {linkable}").selectExpr(*columns, f"{base} as base_spans")
    plain = plain.selectExpr("*", "base_spans as spans")

    # An opaque string needs a digit and a letter, and must not overlap a strong finding.
    mixed = "(substring({t}, x.start + 1, x.end - x.start) rlike '[0-9]' and substring({t}, x.start + 1, x.end - x.start) rlike '[A-Za-z]')"
    opaque = f"filter({spans_sql(OPAQUE)}, x -> {mixed.format(t=_TEXT)} and not exists(base_spans, b -> b.start < x.end and x.start < b.end))"
    rest = (
        docs.where(linkable)
        .selectExpr(*columns, f"{base} as base_spans")
        .selectExpr(
            "*",
            f"concat(filter(base_spans, b -> b.kind = {ACCESS}), {opaque}, {spans_sql(IDENT)}, {spans_sql(ENDPOINT)}) as __parts",
            "monotonically_increasing_id() as __row",  # fixed once it is written
        )
    )
    rest = stored(rest, "linkable")
    linked = rest.select(*docs.columns, "base_spans", "__row").join(_linked(rest), "__row", "left")
    linked = linked.selectExpr(
        *columns, "base_spans", f"sort_array(array_union(base_spans, coalesce(__weak, cast(array() as {_SPANS})))) as spans"
    )
    return plain.unionByName(linked)


def _linked(rest: DataFrame) -> DataFrame:
    """Per row: the weak spans whose complementary parts lie in scope."""
    parts = rest.selectExpr("__row", "inline(__parts)")
    anchors = parts.where(f"kind = {OPAQUE}").selectExpr(
        "__row", "start as o_start", "end as o_end",
        f"explode(sequence(cast(floor((start - {SCOPE}) / {STRETCH}) as int), cast(floor((end + {SCOPE}) / {STRETCH}) as int))) as stretch",
    )
    others = parts.where(f"kind <> {OPAQUE}").selectExpr(
        "*", f"explode(sequence(cast(floor(start / {STRETCH}) as int), cast(floor(end / {STRETCH}) as int))) as stretch"
    )
    pairs = anchors.join(others, ["__row", "stretch"]).where(f"start <= o_end + {SCOPE} and end >= o_start - {SCOPE}")
    complete = (
        pairs.groupBy("__row", "o_start", "o_end")
        .agg(
            F.expr(f"bool_or(kind in ({ACCESS}, {IDENT}))").alias("has_id"),
            F.expr(f"bool_or(kind = {ENDPOINT})").alias("has_endpoint"),
            F.expr(f"collect_set(case when kind in ({IDENT}, {ENDPOINT}) then struct(start, kind, end) end)").alias("near"),
        )
        .where("has_id and has_endpoint")
    )
    spans = complete.selectExpr(
        "__row", f"explode(concat(array(named_struct('start', o_start, 'kind', {OPAQUE}, 'end', o_end)), near)) as span"
    )
    return spans.groupBy("__row").agg(F.collect_set("span").cast(_SPANS).alias("__weak"))


def redact(found: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``find_secrets`` rows with every strong or opaque span of ``text`` replaced by ``mask``.

    Overlapping spans are masked as one. ``n_chars`` follows the text where the table has it; a text
    without findings, null included, stays as it is.
    """
    secret = f"filter(spans, x -> x.kind <= {OPAQUE})"
    step = (
        "named_struct('at', greatest(a.at, x.end), 'out', case when x.start < a.at then a.out else "
        f"concat(a.out, substring(text, a.at + 1, x.start - a.at), '{mask}') end)"
    )
    masked = (
        f"aggregate({secret}, named_struct('at', 0, 'out', ''), (a, x) -> {step}, "
        "a -> concat(a.out, substring(text, a.at + 1, length(text))))"
    )
    columns = [c for c in found.columns if c not in ("base_spans", "spans")]
    text = f"case when size({secret}) > 0 then {masked} else text end"
    out = found.selectExpr(*(f"{text} as text" if c == "text" else f"`{c}`" for c in columns))
    if "n_chars" in columns:
        kind = dict(found.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return out


def masked_rows(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets masked, ``n_chars`` following where a text was; all else as it is, whatever its name."""
    found = find_secrets(docs.select(F.struct("*").alias("row"), "text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        same, length = F.col("text").eqNullSafe(F.col("row.text")), F.length("text").cast(dict(docs.dtypes)["n_chars"])
        row = row.withField("n_chars", F.when(same, F.col("row.n_chars")).otherwise(length))
    return redact(found, mask).select(row.alias("row")).select("row.*")
