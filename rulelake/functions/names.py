"""Names as column expressions: namespaces, type names, route ids, search keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"


def namespace(name: Column) -> Column:
    """The part before the first slash; null for a name without one."""
    return F.when(F.instr(name, "/") > 0, F.substring_index(name, "/", 1))


def local_name(name: Column) -> Column:
    """The part after the last slash, or the whole name."""
    return F.substring_index(name, "/", -1)


def display_parts(name: Column) -> Column:
    """(name, ns): cut at the last slash, else at the last dot. Quoted and bracketed names and symbol[..] stay whole."""
    whole = name.rlike(r'^(["\[]|symbol\[)')
    slash, dot = F.instr(name, "/") > 0, F.instr(name, ".") > 0
    by = lambda sign: F.substring_index(name, sign, -1)
    rest = lambda sign: F.left(name, F.length(name) - F.length(F.substring_index(name, sign, -1)) - 1)
    short = F.when(whole, name).when(slash, by("/")).when(dot, by(".")).otherwise(name)
    ns = F.when(whole, F.lit("")).when(slash, rest("/")).when(dot, rest(".")).otherwise(F.lit(""))
    return F.struct(short.alias("name"), ns.alias("ns"))


def production_ns(ns: Column, name: Column) -> Column:
    return F.coalesce(ns, namespace(name))


def collated(name: Column) -> Column:
    """A name that sorts as readers expect it: letters first, then accents, then small before large, by the root locale."""
    return F.collate(name, "UNICODE")


def resource_path(ns: Column) -> Column:
    """Namespace to source path: dots to slashes, hyphens to underscores."""
    return F.translate(ns, ".-", "/_")


def quoted(text: Column) -> Column:
    """The text as it is printed: in quotes, with escapes."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\f", "\\f"), ("\b", "\\b")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def type_name(kind: Column, text: Column, resolved: Column | None = None) -> Column:
    """Printed name of a fact type by kind; kinds never collide. A symbol that its namespace knows has the resolved name.

    Classes, tuples, maps and functions are printed as their text says. A null text has no name."""
    known = F.lit(None).cast("string") if resolved is None else resolved
    symbol = F.coalesce(known, F.concat(F.lit("symbol["), text, F.lit("]")))
    return F.when(kind == "keyword", F.concat(F.lit(":"), text)).when(kind == "string", quoted(text)).when(kind == "symbol", symbol).otherwise(text)


def type_namespace(kind: Column, text: Column) -> Column:
    """The namespace of a keyword or symbol, the package of a class; null for others and where there is none."""
    package = F.when(F.instr(text, ".") > 0, F.left(text, F.length(text) - F.length(F.substring_index(text, ".", -1)) - 1))
    return F.when(kind.isin("keyword", "symbol"), namespace(text)).when(kind == "class", package)


def kind_of(name: Column) -> Column:
    """The kind that a printed name tells of."""
    return F.when(name.startswith(":"), "keyword").when(name.startswith('"'), "string").when(name.startswith("symbol["), "symbol").when(name.startswith("["), "tuple").when(name.startswith("{"), "map").otherwise("class")


def slug(name: Column) -> Column:
    """At most 60 of the letters, digits, dots and hyphens; runs of anything else become one hyphen, none at the ends
    before the cut. Nothing left: x."""
    runs = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9.-]", "-"), "-+", "-")
    cut = F.left(F.regexp_replace(runs, "^-|-$", ""), F.lit(60))
    return F.when(cut == "", "x").otherwise(cut)


def base36(hex_digest: Column) -> Column:
    """A 160-bit hex digest in base 36: long division of 32-bit limbs by 36 ** 5, five digits a round."""
    limbs = F.array(*[F.conv(F.substring(hex_digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(5)])
    step = 36**5
    five = lambda n: F.concat(*[F.substring(F.lit(BASE36), (F.floor(n / 36**k) % 36 + 1).cast("int"), F.lit(1)) for k in (4, 3, 2, 1, 0)])

    # the quotient needs integer division, as doubles lose the low bits
    def exact(limbs: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("q"), F.lit(0).cast("long").alias("r"))

        def one(s: Column, x: Column) -> Column:
            v = s["r"] * F.lit(2**32) + x
            r = F.pmod(v, F.lit(step))
            return F.struct(F.concat(s["q"], F.array(((v - r) / F.lit(step)).cast("long"))).alias("q"), r.alias("r"))

        return F.aggregate(limbs, start, one)

    state = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(limbs.alias("q"), F.lit("").alias("out")), lambda s, _: F.struct(exact(s["q"])["q"].alias("q"), F.concat(five(exact(s["q"])["r"]), s["out"]).alias("out")))
    return F.regexp_replace(state["out"], "^0+(?=.)", "")


def first_digits(hex_digest: Column, length: int) -> Column:
    """The first digits of base36, without the others. 36 ** k is 4 ** k * 9 ** k, so what is above the lowest 44 bits tells the
    quotients by 36 ** 23 and 36 ** 22, which are the first eight digits of all but a thousandth of digests."""
    whole = F.left(base36(hex_digest), F.lit(length))
    if length > 8:
        return whole
    part = lambda at, n: F.conv(F.substring(hex_digest, at, n), 16, 10)
    above = part(1, 14).cast("decimal(18,0)") * F.lit(2**60).cast("decimal(19,0)") + part(15, 15).cast("decimal(19,0)")
    digits = lambda by: F.lower(F.conv(F.call_function("div", above, F.lit(Decimal(by))).cast("string"), 10, 36))
    long, short = digits(4 * 9**23), digits(9**22)
    return F.left(F.when(F.length(long) == 8, long).when(F.length(short) == 8, short).otherwise(whole), F.lit(length))


def route_id(name: Column, length: int = 8) -> Column:
    """A readable and stable id: slug and the first digits of the name's SHA-1 in base 36. Null stays null."""
    return F.when(name.isNotNull(), F.concat(slug(name), F.lit("-"), first_digits(F.sha1(F.encode(name, "UTF-8")), length)))


def type_ref(name: Column, known: Column) -> Column:
    """{name, id, known}, null without a name."""
    return F.when(name.isNotNull(), F.struct(name.alias("name"), route_id(name).alias("id"), F.coalesce(known, F.lit(False)).alias("known")))


def matches(text: Column, query: str) -> Column:
    """Case-insensitive search of the whole query as one piece; an empty one matches everything. A null text matches none but that."""
    q = query.lower()
    return F.lit(True) if not q else F.coalesce(F.contains(F.lower(text), F.lit(q)), F.lit(False))
