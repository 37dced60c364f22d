"""Facts in product titles and search text, as functions from Column to Column. No Python runs per row.

White space in patterns is S: Java's `\\s` and the Unicode spaces that occur in shop titles. Where a pattern finds nothing, the
result is null, not ''. Null input gives null unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

S = r"[\s   -     　﻿]"

# ------------------------------------------------------------------------------------------------ fixed values

#: (pattern, brand), the first that matches wins.
BRAND_RULES = (
    (r"western\s+digital", "Western Digital"), (r"\bwd[\s_]?black\b", "Western Digital"), (r"\bwd[\s_]", "Western Digital"), (r"\bwd_?black\b", "Western Digital"),
    (r"\bfury\b", "Kingston"), (r"\btrident\b", "G.Skill"), (r"\bripjaws\b", "G.Skill"), (r"\bvengeance\b", "Corsair"), (r"\bdominator\b", "Corsair"),
    (r"990\s*pro", "Samsung"), (r"980\s*pro", "Samsung"), (r"870\s*evo", "Samsung"), (r"960\s*evo", "Samsung"), (r"870\s*qvo", "Samsung"), (r"9100\s*pro", "Samsung"), (r"\bt7\b", "Samsung"), (r"^\s*mz-", "Samsung"),
    (r"\bt500\b", "Crucial"), (r"\bt705\b", "Crucial"), (r"\bp310\b", "Crucial"), (r"\bp510\b", "Crucial"), (r"\bp3\b", "Crucial"), (r"\bbx500\b", "Crucial"), (r"\bmx500\b", "Crucial"), (r"\bct\d", "Crucial"),
    (r"ssd\s*plus", "SanDisk"), (r"sandisk\s*ultra", "SanDisk"), (r"corsair", "Corsair"), (r"g\.?\s?skill", "G.Skill"), (r"crucial", "Crucial"), (r"kingston", "Kingston"), (r"samsung", "Samsung"), (r"teamgroup", "TEAMGROUP"),
    (r"sandisk", "SanDisk"), (r"lexar", "Lexar"), (r"patriot", "Patriot"), (r"adata", "ADATA"), (r"\bpny\b", "PNY"), (r"silicon\s+power", "Silicon Power"), (r"seagate", "Seagate"), (r"mushkin", "Mushkin"), (r"timetec", "Timetec"),
    (r"netac", "Netac"), (r"kingspec", "KingSpec"), (r"sabrent", "Sabrent"), (r"solidigm", "Solidigm"),
)

#: Words that say nothing about a product line.
FILLER = (
    "ram", "memory", "memories", "desktop", "computer", "pc", "internal", "gaming", "module", "modules", "upgrade", "kit", "kits", "single", "dual",
    "quad", "channel", "performance", "high", "speed", "speeds", "low", "profile", "latency", "intel", "amd", "xmp", "expo", "ready", "compatible",
    "compatibility", "for", "with", "without", "w/o", "and", "the", "of", "up", "to", "up-to", "only", "new", "series", "non-ecc", "unbuffered",
    "buffered", "pin", "dimm", "udimm", "sodimm", "u-dimm", "so-dimm", "laptop", "notebook", "ssd", "ssds", "drive", "drives", "solid", "state",
    "hard", "disk", "nvme", "sata", "iii", "m.2", "2280", "2242", "2230", "2.5", "2.5in", "2.5-inch", "inch", "pcie", "pcle", "gen", "read", "write",
    "transfer", "rate", "maximum", "max", "sequential", "heatsink", "storage", "expansion", "black", "white", "grey", "gray", "silver", "red", "blue",
    "green", "gold", "titanium",
)

#: Whole tokens that are figures, not names of a line.
FIGURES = (
    r"\d+(\.\d+)?(gb|tb)", r"\d+x\d+(gb|tb)", r"\d+-?pack", r"\d{4,5}(mhz|mt/?s?|mts)", r"ddr[45](-\d{3,5})?", r"pc[45]?\d*-\d{4,6}", r"cl\s?\d{1,2}", r"cl?\d{1,2}-\d{1,2}-\d{1,2}(-\d{1,3})?",
    r"\d\.\d{1,3}v", r"\d{3}-?pin", r"gen[3-5](x[248])?", r"[3-5]\.0", r"x[248]", r"\d+(,\d+)?(mb/s|mbs|mb)", r"gb/?s", r"mb/?s", r"\d+gb/s",
)

#: What looks like a part number but is a specification.
SPEC_WORD = r"^(?:\d+X\d+(?:GB|TB)|DDR[45][-\d]*|PC[34][-\d]+|CL\d[\d-]*|\d+(?:GB|TB|MHZ|MTS?)|\d+MT/S|XMP[\d.]*|EXPO|AMD|INTEL|RGB|NVME|SATA(?:\s?III)?|SSD|M\.2|2280|2242|PCIE[\d.X]*|GEN[\d.X]+|U-?DIMM|SO-?DIMM|RDIMM|QLC|TLC|NAND|\d+V|1\.\d+V|PS5|PC)$"

#: A capacity; a part number as a title has it (6 characters at least) and as a whole token (8 at least).
_CAPACITY = r"(?i)(\d+)\s*(gb|tb)(?![\w/])"
PART_NUMBER, PART_TOKEN = r"^[A-Z0-9][A-Z0-9\-/.]{5,}$", r"^[A-Z0-9][A-Z0-9\-/.]{7,}$"
#: Speeds, memory in a notebook, drives that are no internal ones.
SPEEDS = (r"(?i)(\d{4,5})\s*(?:mhz|mt/s)", r"(?i)ddr[45]-(\d{4,5})")
SMALL_MEMORY, EXTERNAL = "sodimm|so-dimm|laptop|notebook|260-pin|262-pin", r"\b(portable|external|usb)\b"

SEGMENTS = ("ddr5", "ddr4", "nvme_ssd", "sata_ssd")
SEGMENT_LABELS = {"ddr5": "DDR5", "ddr4": "DDR4", "nvme_ssd": "NVMe SSD", "sata_ssd": "SATA SSD"}

# ------------------------------------------------------------------------------------------------ helpers


def has(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, case aside."""
    return c.rlike("(?i)" + pattern)


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group; null if there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def all_found(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def let(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def one_of(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ------------------------------------------------------------------------------------------------ titles

def capacities_gb(c: Column) -> Column:
    """Every capacity in a title, in GB; endurance (TBW) and interface speeds (Gb/s) are none."""
    return F.zip_with(all_found(c, _CAPACITY, 1), all_found(c, _CAPACITY, 2), lambda n, unit: F.try_to_number(n, F.lit("999999999")).cast("int") * F.when(F.lower(unit) == "tb", 1024).otherwise(1))


def total_capacity_gb(c: Column) -> Column:
    """The largest capacity before the first bracket, which is a kit's total; else the largest at all."""
    return F.coalesce(F.array_max(capacities_gb(F.substring_index(c, "(", 1))), F.array_max(capacities_gb(c)))


def capacity_label(gb: Column) -> Column:
    return F.when((gb >= 1024) & (gb % 1024 == 0), F.concat((gb / 1024).cast("int").cast("string"), F.lit("TB"))).otherwise(F.concat(gb.cast("int").cast("string"), F.lit("GB")))


def speed_mhz(c: Column) -> Column:
    """The largest of a title's speeds from 1800 to 9000; larger figures are bandwidth codes."""
    figures = F.concat(*[all_found(c, p, 1) for p in SPEEDS])
    return F.array_max(F.filter(F.transform(figures, lambda x: x.cast("int")), lambda x: x.between(1800, 9000)))


def ram_type(c: Column) -> Column:
    return F.when(has(c, "ddr5"), "DDR5").when(has(c, "ddr4"), "DDR4")


def ssd_type(c: Column) -> Column:
    """SATA first: an M.2 drive may speak SATA."""
    return F.when(has(c, r"sata|2\.5"), "SATA").when(has(c, r"nvme|m\.2"), "NVMe")


def form_factor(c: Column) -> Column:
    return F.when(has(c, r"m\.2"), "M.2").when(c.contains("2.5"), '2.5"')


def latency(c: Column) -> Column:
    return F.concat(F.lit("CL"), found(c, r"(?i)\bCL\s?(\d{2})\b", 1))


def _is_mpn(c: Column) -> Column:
    return c.rlike(PART_NUMBER) & c.rlike("[A-Z]") & (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 3) & ~c.rlike(SPEC_WORD)


def part_number(c: Column) -> Column:
    """The last bracketed text that can be a part number, else the last word, unless a short capital word before it says that it is cut."""
    # not F.trim itself: transform would give it an element's place as the characters to trim
    bracketed = F.filter(F.transform(all_found(c, r"\(([^)]+)\)", 1), lambda x: F.trim(x)), _is_mpn)
    words = F.filter(F.split(F.regexp_replace(c, r"[(),]", " "), S + "+"), lambda w: w != "")
    last, before = F.try_element_at(words, F.lit(-1)), F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit(""))
    return F.coalesce(F.try_element_at(bracketed, F.lit(-1)), F.when(_is_mpn(last) & ~before.rlike("^[A-Z]{1,3}$"), last))


def segment(category: Column, name: Column) -> Column:
    """ddr5, ddr4, sata_ssd or nvme_ssd; null: in none."""
    ram = F.when(has(name, "ddr5"), "ddr5").when(has(name, "ddr4"), "ddr4")
    ssd = F.when(has(name, r"sata|2\.5"), "sata_ssd").when(has(name, r"nvme|m\.2"), "nvme_ssd")
    return F.when(category == "ram", ram).when(category == "ssd", ssd)


def speed_band(mhz: Column) -> Column:
    return F.when(mhz >= 6000, "6000MHz+").when(mhz >= 5500, "5600MHz").when(mhz >= 5000, "5200MHz").when(mhz.isNotNull(), "4800MHz & below")


def brand_of(name: Column) -> Column:
    return F.coalesce(*[F.when(has(name, p), b) for p, b in BRAND_RULES])


def title_tokens(name: Column) -> Column:
    """Words of a title without throughput figures and brackets, edges trimmed to letters and digits."""
    t = F.regexp_replace(name, r"(?i)\d[\d,/.]*\s*(?:mb/?s|gb/?s)\b", " ")
    t = F.regexp_replace(t, r"(\d),(\d)", "$1$2")
    t = F.regexp_replace(t, r'[()\[\]【】,|·"“”]', " ")
    return F.filter(F.transform(F.split(t, S + "+"), lambda w: F.regexp_replace(w, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")), lambda w: w != "")


def is_part_number(token: Column) -> Column:
    return token.rlike(PART_TOKEN) & token.rlike("[A-Z]") & (F.length(F.regexp_replace(token, "[^0-9]", "")) >= 3)


def line_signature(name: Column, brand: Column) -> Column:
    """The tokens that name a product line, in order, repeated ones kept."""
    brands = F.split(F.lower(F.coalesce(brand, F.lit(""))), S + "+")
    figure = "^(?:" + "|".join(FIGURES) + ")$"
    kept = F.transform(F.filter(title_tokens(name), lambda w: ~is_part_number(w)), F.lower)
    # the brand is split once, not for each word
    return let(brands, lambda b: F.filter(kept, lambda w: ~F.array_contains(b, w) & ~w.isin(list(FILLER)) & ~w.rlike(figure)))


def ram_form(name: Column) -> Column:
    return F.when(has(name, SMALL_MEMORY), "sodimm").otherwise("dimm")


def pcie_generation(name: Column) -> Column:
    """g3, g4, g5 or ''."""
    n = F.coalesce(found(name, r"(?i)(?:pcie|pcle)[\s-]*(?:gen)?[\s-]*([3-5])(?:\.0)?", 1), found(name, r"(?i)\bgen\s?([3-5])\b", 1))
    return F.coalesce(F.concat(F.lit("g"), n), F.lit(""))


def heatsink(name: Column) -> Column:
    return F.when(has(name, r"without\s+heatsink|w/o\s+heatsink|no\s+heatsink"), "").when(has(name, "heatsink"), "hs").otherwise("")


def invariants(category: Column, name: Column) -> Column:
    """Four facts that members of a line share; an unknown one equals only an unknown one."""
    or_else = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    ram = F.array(or_else(ram_type(name), "nogen"), or_else(speed_mhz(name).cast("string"), "nospeed"), or_else(latency(name), "nocl"), ram_form(name))
    ssd = F.array(or_else(ssd_type(name), "noproto"), or_else(form_factor(name), "noform"), or_else(pcie_generation(name), "nogen"), or_else(heatsink(name), "nohs"))
    return F.when(category == "ram", ram).otherwise(ssd)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def line_key(category: Column, brand: Column, name: Column) -> Column:
    """Key of a product line from its title; null if no word names the line."""
    return let(line_signature(name, brand), lambda words: key_of(category, brand, words, invariants(category, name)))


def key_of(category: Column, brand: Column, words: Column, facts: Column) -> Column:
    """line_key() from a title's line signature and invariants."""
    parts = F.concat_ws(" ", category, F.coalesce(F.nullif(F.lower(brand), F.lit("")), F.lit("x")), F.array_join(words, " "), F.array_join(facts, " "))
    return F.when(F.size(words) > 0, slugify(parts))


# ------------------------------------------------------------------------------------------------ names and slugs


def _cut_at_space(c: Column) -> Column:
    """Up to the last space; without one the last character goes."""
    return F.coalesce(found(c, r"(?s)^(.*) ", 1), F.when(F.instr(c, " ") > 0, F.lit("")).otherwise(F.substring(c, F.lit(1), F.length(c) - 1)))


def short_name(name: Column, brand: Column) -> Column:
    """The title up to the first bracket or comma, with the brand before it if it lacks it; 8 words and 42 characters at most."""
    lead = F.trim(F.substring_index(F.substring_index(name, "(", 1), ",", 1))
    lacks = lambda x: (F.coalesce(brand, F.lit("")) != "") & ~F.startswith(F.lower(x), F.substring(F.lower(brand), 1, 4))
    base = let(lead, lambda x: F.when(lacks(x), F.concat(brand, F.lit(" "), x)).otherwise(x))
    words = F.array_join(F.slice(F.split(base, S + "+"), 1, 8), " ")
    return let(words, lambda w: F.when(F.length(w) > 42, _cut_at_space(F.substring(w, 1, 42))).otherwise(w))


def slug_of(category: Column, name: Column, brand: Column) -> Column:
    """Short name, with capacity and memory speed where it lacks them, as a slug of 80 characters at most."""
    cap, speed = capacity_label(total_capacity_gb(name)), F.when(category == "ram", speed_mhz(name)).cast("string")
    with_cap = lambda x: let(cap, lambda c: F.when(c.isNotNull() & ~F.contains(F.lower(x), F.lower(c)), F.concat(x, F.lit(" "), c)).otherwise(x))
    with_speed = lambda x: let(speed, lambda v: F.when(v.isNotNull() & ~F.contains(x, v), F.concat(x, F.lit(" "), v, F.lit("mhz"))).otherwise(x))
    slug = slugify(let(let(short_name(name, brand), with_cap), with_speed))
    return let(slug, lambda x: F.when(F.length(x) > 80, F.coalesce(found(F.substring(x, 1, 80), "^(.*)-", 1), F.substring(x, 1, 80))).otherwise(x))


def cap_words(c: Column, budget: Column | int) -> Column:
    """At most budget characters; a word is cut off only if the space lies past half the budget."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    at = lambda h: F.length(h) - F.instr(F.reverse(h), " ")
    cut = lambda h: F.when((F.instr(h, " ") > 0) & (at(h) > b * 0.5), F.substring(h, F.lit(1), at(h))).otherwise(h)
    return let(c, lambda x: F.when(b <= 0, "").when(F.length(x) <= b, F.trim(x)).otherwise(F.trim(let(F.substring(x, F.lit(1), b), cut))))


TOKEN_KINDS = ("speed", "cl", "color", "heatsink", "pack")


def token_value(name: Column, kind: str) -> Column:
    """An attribute that can tell two equal titles apart."""
    if kind == "speed":
        return F.concat(speed_mhz(name).cast("string"), F.lit("MHz"))
    if kind == "cl":
        return latency(name)
    if kind == "color":
        return found(name, r"(?i)\b(Black|White|Gray|Grey|Silver|Green|Blue|Red|Royal)\b", 1)
    if kind == "heatsink":
        return F.when(has(name, "non-?heatsink|without heatsink|w/o heatsink"), "No Heatsink").when(has(name, "heatsink"), "Heatsink")
    return F.concat(found(name, r"(?i)(\d+)[\s-]?pack", 1), F.lit("-Pack"))


# ------------------------------------------------------------------------------------------------ search


def search_text(c: Column) -> Column:
    """Lower-case letters, digits and white space; null gives ''."""
    # what stays is matched too: looking from one rare sign to the next takes Java several times as long
    kept = "a-z0-9" + S[1:-1]
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"([a-z0-9 ]+|[{kept}]+)|[^{kept}]+", "$1")


def compact(c: Column) -> Column:
    """search_text() without its white space, in one pass."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def search_tokens(query: str) -> list[str]:
    """Tokens of a query, on the driver."""
    kept = "".join(ch for ch in query.lower() if ch.isspace() or (ch.isascii() and ch.isalnum()))
    return kept.split()


def matches_query(query: str, text: Column) -> Column:
    """Every token occurs in the text, spaced or compact; a query without tokens matches nothing.

    A token has no white space, so what occurs in the spaced text occurs in the compact one: that alone is looked at, and made
    once for all tokens.
    """
    tokens = search_tokens(query)
    if not tokens:
        return F.lit(False)
    return let(compact(text), lambda c: reduce(lambda a, b: a & b, [F.contains(c, F.lit(t)) for t in tokens]))


def highlight_ranges(name: Column, tokens: Column) -> Column:
    """Sorted, merged (start, end) ranges, from 0, of each token's first place; touching ranges merge."""
    places = F.transform(tokens, lambda t: F.struct((F.instr(F.lower(name), t) - 1).alias("a"), (F.instr(F.lower(name), t) - 1 + F.length(t)).alias("b")))
    places = F.array_sort(F.filter(places, lambda r: r["a"] >= 0))
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))))
        return F.when(r["a"] <= last["b"], joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(places, empty, step)


def highlighted(name: Column, tokens: Column) -> Column:
    """The escaped name with its ranges in <strong>."""
    ranges = highlight_ranges(name, tokens)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, r: Column) -> Column:
        before = F.substring(name, state["at"] + 1, r["a"] - state["at"])
        return F.struct(F.concat(state["out"], escaped(before), F.lit("<strong>"), escaped(F.substring(name, r["a"] + 1, r["b"] - r["a"])), F.lit("</strong>")).alias("out"), r["b"].alias("at"))

    return F.aggregate(ranges, start, step, lambda s: F.concat(s["out"], escaped(F.substring(name, s["at"] + 1, F.length(name)))))


# ------------------------------------------------------------------------------------------------ markup, links


def _replaced(c: Column, pairs) -> Column:
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), pairs, c)


def escaped(c: Column) -> Column:
    """Entities for & < > " '; null gives ''."""
    return _replaced(F.coalesce(c, F.lit("")), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def escaped_xml(c: Column) -> Column:
    return _replaced(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def with_tag(url: Column, tag: str) -> Column:
    """A link with an affiliate tag; without a link '#'."""
    return F.when(F.coalesce(url, F.lit("")) == "", "#").otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("tag=" + tag)))


def uri_component(c: Column) -> Column:
    """Percent-encoding as in links of scripts: letters, digits and - _ . ! ~ * ' ( ) stay."""
    return _replaced(F.url_encode(c), (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%2A", "*")))


def deep_link(url: Column, affiliate: Column, merchant: str, base: str) -> Column:
    """A tracked link; fails for a link that is not absolute and for a missing affiliate id."""
    bad = ~F.coalesce(has(url, "^https?://"), F.lit(False))
    none = F.coalesce(affiliate, F.lit("")) == ""
    link = F.concat(F.lit(base + "?id="), affiliate, F.lit("&mid=" + merchant + "&murl="), uri_component(url))
    return F.when(bad, F.raise_error(F.lit("deep_link: the link must be an absolute http(s) URL")).cast("string")).when(none, F.raise_error(F.lit("deep_link: the affiliate id is missing")).cast("string")).otherwise(link)


def large_image(url: Column) -> Column:
    """The 1200-pixel variant of a picture whose URL holds a size token."""
    return F.regexp_replace(url, r"(?i)\._AC_[A-Z0-9_]+_\.(jpe?g|png)$", "._AC_SL1200_.$1")


def normal_mpn(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def content_hash(html: Column) -> Column:
    """sha256 of a page without what changes on every build."""
    t = F.regexp_replace(html, r"\?v=\d+", "?v=")
    t = F.regexp_replace(t, "Last updated: [^<]*", "Last updated: ")
    t = F.regexp_replace(t, '"priceValidUntil": "[^"]*"', '"priceValidUntil": ""')
    return F.sha2(F.regexp_replace(t, '"validFrom": "[^"]*"', '"validFrom": ""'), 256)


def _rows(pairs) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(k).alias("label"), v.alias("value"))) for k, v in pairs]))


def spec_rows(category: Column, name: Column, brand: Column) -> Column:
    """(label, value) of what is known of a product, in order."""
    cap = capacity_label(total_capacity_gb(name))
    ram = _rows((("Type", ram_type(name)), ("Capacity", cap), ("Speed", F.concat(speed_mhz(name).cast("string"), F.lit("MHz"))), ("Latency", latency(name)), ("Brand", brand)))
    ssd = _rows((("Type", ssd_type(name)), ("Capacity", cap), ("Form Factor", form_factor(name)), ("Brand", brand)))
    return F.when(category == "ram", ram).otherwise(ssd)


def spec_summary(category: Column, name: Column) -> Column:
    cap, kind, speed = capacity_label(total_capacity_gb(name)), ram_type(name), speed_mhz(name).cast("string")
    ram = F.concat_ws(" · ", cap, F.when(speed.isNotNull(), F.concat(kind, F.lit("-"), speed)).otherwise(kind), latency(name))
    return F.when(category == "ram", ram).otherwise(F.concat_ws(" · ", cap, ssd_type(name), form_factor(name)))


# ------------------------------------------------------------------------------------------------ catalog harvest


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def leading_number(c: Column) -> Column:
    """The number a text begins with; null if with none."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def price_of(lowest: Column, price: Column, highest: Column) -> Column:
    return leading_number(first_filled(lowest, price, highest))


def fits_category(name: Column, category: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(category == "ram", F.contains(n, F.lit("ddr"))).when(category == "ssd", F.contains(n, F.lit("ssd")) | F.contains(n, F.lit("nvme"))).otherwise(False)


def is_external(name: Column) -> Column:
    return has(F.coalesce(name, F.lit("")), EXTERNAL)


# ------------------------------------------------------------------------------------------------ alerts


def is_token(c: Column) -> Column:
    return c.rlike("^[a-f0-9]{64}$")


def masked_email(c: Column) -> Column:
    """The first two characters and the domain."""
    return F.when(F.contains(F.coalesce(c, F.lit("")), F.lit("@")), F.concat(F.substring(c, 1, 2), F.lit("***@"), F.split(c, "@")[1])).otherwise("(none)")


def alert_errors(email: Column, price: Column, product: Column) -> Column:
    """What is wrong with a request for an alert, as codes; price is text."""
    number = leading_number(price)
    e = F.coalesce(email, F.lit(""))
    trimmed = F.regexp_replace(e, f"^{S}+|{S}+$", "")
    shape = trimmed.rlike(f"^(?:(?!{S})[^@])+@(?:(?!{S})[^@])+\\.(?:(?!{S})[^@])+$")
    of_email = F.when(e == "", "email_missing").when(~shape, "email_invalid").when(F.length(e) > 254, "email_too_long")
    of_price = F.when(F.coalesce(price, F.lit("")) == "", "price_missing").when(number.isNull(), "price_not_a_number").when(number < 1, "price_too_low").when(number > 10000, "price_too_high")
    of_product = F.when(F.regexp_replace(F.coalesce(product, F.lit("")), S + "+", "") == "", "product_missing")
    return F.array_compact(F.array(of_email, of_price, of_product))


def sanitized_alert(email: Column, price: Column, product: Column) -> Column:
    """Trimmed email in lower case, price as a number, trimmed product; null if anything is wrong."""
    return clean_alert(email, price, product, alert_errors(email, price, product))


def clean_alert(email: Column, price: Column, product: Column, errors: Column) -> Column:
    """sanitized_alert() of a request whose errors are known."""
    trimmed = lambda c: F.regexp_replace(c, f"^{S}+|{S}+$", "")  # noqa: E731  (as alert_errors trims)
    return F.when(F.size(errors) == 0, F.struct(F.lower(trimmed(email)).alias("email"), leading_number(price).alias("target_price"), trimmed(product).alias("product_id")))
