"""Column functions over text: tokens, sentences, codes, scopes, page furniture. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(text) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(_c(text), F.lit(""))) / 4)).cast("int")


def search_tokens(text) -> Column:
    """Lower-case alphanumeric runs of more than two characters without stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*K.STOPWORDS))


def audit_tokens(text) -> Column:
    """Lower-cased runs of letters, digits, $ and %, duplicates kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit("[A-Za-z0-9$%]+"), F.lit(0)), F.lower)


def strip(text) -> Column:
    """Without white space at the ends, also no-break spaces."""
    return F.regexp_replace(_c(text), r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")


def squeeze(text) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))


def sentences(text) -> Column:
    """Citable units: a bullet line is one; any other line splits after [.;:] before a capital or parenthesis, and parts
    of up to 15 characters go."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\r\n|\n|\r"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    bullet = lambda s: F.substring(s, 1, 1).isin("-", "*", "•")
    parts = lambda s: F.filter(F.transform(F.split(s, r"(?<=[.;:])\s+(?=[A-Z(])"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) >= K.MIN_SENTENCE_CHARS)
    return F.flatten(F.transform(lines, lambda s: F.when(bullet(s), F.array(F.regexp_replace(s, "^[-*• ]+", ""))).otherwise(parts(s))))


def normalize_code(code) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(_c(code), F.lit("")))), " ", "")


def classify_code(code) -> Column:
    """cpt, hcpcs, icd10 or unknown, by format."""
    c = normalize_code(code)
    return F.when(c.rlike(K.CPT), "cpt").when(c.rlike(K.HCPCS), "hcpcs").when(c.rlike(K.ICD10), "icd10").otherwise("unknown")


def exception_clause(text) -> Column:
    """From the first exception word to the end, without a final stop; null if there is none."""
    tail = F.regexp_extract(_c(text), K.EXCEPTION + r"[\s\S]*$", 0)
    return F.nullif(F.regexp_replace(F.trim(tail), r"\.+$", ""), F.lit(""))


def cross_references(text) -> Column:
    return F.transform(F.regexp_extract_all(_c(text), F.lit(K.CROSS_REFERENCE), F.lit(0)), F.trim)


def conflicts(text, descriptor) -> Column:
    """Messages of the qualifier conflicts between a provision and a descriptor."""
    prov, desc = F.lower(F.coalesce(_c(text), F.lit(""))), F.lower(F.coalesce(_c(descriptor), F.lit("")))
    each = [F.when(prov.rlike(p) & desc.rlike(d), F.lit(m)) for p, d, m in K.CONFLICTS]
    return F.filter(F.array(*each), lambda m: m.isNotNull())


def is_fragment(text) -> Column:
    t = F.trim(_c(text))
    count = lambda ch: F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))
    return (F.length(t) < K.MIN_PROVISION_CHARS) | t.rlike("^[a-z]") | (count(")") > count("("))


def is_meta(text) -> Column:
    return ~_c(text).rlike(K.RULE_LIKE) & _c(text).rlike(K.META_SENTENCE)


def is_citable(scope, text) -> Column:
    return ~F.trim(_c(text)).rlike(K.ADMINISTRATIVE) & ((_c(scope) != "limitation") | _c(text).rlike(K.LIMIT_LANGUAGE))


def scope_of(breadcrumb) -> Column:
    """exclusion, limitation, definition or null: judged by the deepest division that the breadcrumb names."""
    bc = F.coalesce(_c(breadcrumb), F.lit(""))
    parts = F.filter(F.transform(F.split(bc, ">"), F.trim), lambda p: p != "")
    any_scope = "|".join(p for _, p in K.SCOPES)
    named = F.filter(parts, lambda p: p.rlike(K.DIVISION) | F.lower(p).rlike(any_scope))
    target = F.lower(F.when(F.size(named) > 0, F.element_at(named, -1)).otherwise(bc))
    out = F.when(target.rlike(K.SCOPES[0][1]), K.SCOPES[0][0])
    for name, pattern in K.SCOPES[1:]:
        out = out.when(target.rlike(pattern), name)
    return out


def running_key(text) -> Column:
    """A page line with digits as #, white space squeezed, lower case: equal for lines that run over pages."""
    return F.trim(F.regexp_replace(F.lower(squeeze(text)), "[0-9]+", "#"))


def is_page_number(text) -> Column:
    t = squeeze(text)
    arabic = t.rlike(r"(?i)^(page\s*)?[-\x{2013}\s]*[0-9]{1,4}([-\x{2013}/ ]+(of\s*)?[0-9]{1,4})?[-\x{2013}\s]*$")
    roman = t.rlike(r"^[-\x{2013}\s]*[IVXLCivxlc]{1,7}[-\x{2013}\s]*$")
    code = F.trim(F.regexp_replace(t, r"\s+[0-9]{1,4}$", "")).rlike(K.FORM_CODE)
    return (t != "") & (arabic | roman | code)


def roman_to_int(text) -> Column:
    """The value of a roman numeral, null if a character is none."""
    digits = F.reverse(F.split(F.lower(_c(text)), ""))
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.when(d == "i", 1).when(d == "v", 5).when(d == "x", 10).when(d == "l", 50).when(d == "c", 100).when(d == "d", 500).when(d == "m", 1000))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    step = lambda a, v: F.struct(F.when(v < a["most"], a["total"] - v).otherwise(a["total"] + v).alias("total"), F.greatest(a["most"], v).alias("most"))
    total = F.aggregate(values, start, step)["total"]
    return F.when(~F.exists(values, lambda v: v.isNull()) & (total > 0), total)


def form_code(footer) -> Column:
    """struct(code, number) from the end of a footer: up to three dotted identifier tokens before a number; or null."""
    tokens = F.split(F.trim(_c(footer)), r"\s+")
    number = F.element_at(tokens, -1)
    before = F.reverse(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))))
    fits = lambda t: t.rlike(r"^[A-Za-z0-9][A-Za-z0-9._\-]*$") & ~t.endswith(".")
    start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(True).alias("on"))
    go = lambda a, t: a["on"] & fits(t) & ((F.size(a["got"]) == 0) | t.contains(".")) & (F.size(a["got"]) < 3)
    step = lambda a, t: F.struct(F.when(go(a, t), F.concat(F.array(t), a["got"])).otherwise(a["got"]).alias("got"), go(a, t).alias("on"))
    code = F.array_join(F.aggregate(before, start, step)["got"], " ")
    dots = F.length(code) - F.length(F.replace(code, F.lit("."), F.lit("")))
    value = F.when(number.rlike("^[0-9]{1,4}$"), number.cast("int"))
    ok = (F.size(tokens) >= 2) & (value >= 1) & (dots >= 2) & code.rlike("[0-9A-Z]")
    return F.when(ok, F.struct(code.alias("code"), value.alias("number")))


def toc_entry(line) -> Column:
    """struct(title, page) of a contents line with leaders or a wide gap before its page; or null."""
    s = F.regexp_replace(_c(line), r"\s+$", "")
    lead = s.rlike(K.TOC_LEADER)
    title = squeeze(F.when(lead, F.regexp_extract(s, K.TOC_LEADER, 1)).otherwise(F.regexp_extract(s, K.TOC_PLAIN, 1)))
    page = F.when(lead, F.regexp_extract(s, K.TOC_LEADER, 2)).otherwise(F.regexp_extract(s, K.TOC_PLAIN, 2))
    ok = ~s.rlike(K.TOC_TITLE) & (lead | s.rlike(K.TOC_PLAIN)) & (F.length(title) >= 4) & title.rlike(r"\p{L}")
    return F.when(ok, F.struct(title.alias("title"), page.alias("page")))


def attributes(text) -> Column:
    """The key=value pairs of an anchor as a map; the last value of a key wins."""
    pairs = F.regexp_extract_all(_c(text), F.lit(r"([A-Za-z0-9_]+)=([^\s]+)"), F.lit(0))
    start = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(pairs, start, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != F.substring_index(p, "=", 1)), F.create_map(F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", ""))))


def breadcrumb(path) -> Column:
    return F.concat_ws(" > ", F.filter(_c(path), lambda p: p.isNotNull() & (p != "")))


def embed_text(bc, body, note=None) -> Column:
    """What is embedded: the section, an optional note, the body."""
    head = F.when(_c(bc) != "", F.concat(F.lit("Section: "), _c(bc)))
    middle = F.when(note != "", F.concat(F.lit("["), note, F.lit("]"))) if note is not None else F.lit(None).cast("string")
    return F.trim(F.concat(F.coalesce(F.concat_ws("\n", head, middle), F.lit("")), F.lit("\n\n"), _c(body)))


def citation(page_start, page_end, printed_start, printed_end, form, pdf_label="p.") -> Column:
    """The printed pages (p. or pp.), with the form before them, or else the pages of the file."""
    lo, hi = _c(printed_start), F.coalesce(_c(printed_end), _c(printed_start))
    printed = F.when(lo == hi, F.concat(F.lit("p. "), lo.cast("string"))).otherwise(F.concat(F.lit("pp. "), lo.cast("string"), F.lit("-"), hi.cast("string")))
    pdf = F.concat(F.lit(f"{pdf_label} "), _c(page_start).cast("string"), F.when(_c(page_end) > _c(page_start), F.concat(F.lit("-"), _c(page_end).cast("string"))).otherwise(F.lit("")))
    where = F.when(lo.isNotNull(), printed).otherwise(pdf)
    return F.concat_ws(", ", F.when(lo.isNotNull() & (F.coalesce(_c(form), F.lit("")) != ""), _c(form)), where)


def quoted_provision(lead_in, text) -> Column:
    """The lead-in chain, each level indented by two more spaces, then the text."""
    lines = F.transform(_c(lead_in), lambda p, i: F.concat(F.repeat(F.lit("  "), i), p))
    own = F.concat(F.repeat(F.lit("  "), F.size(_c(lead_in))), _c(text))
    return F.array_join(F.concat(lines, F.array(own)), "\n")


def chunk_id(doc_id, seq) -> Column:
    key = F.concat(_c(doc_id), F.lit("#"), _c(seq).cast("string"))
    return F.concat(F.format_string("%s#%05d-", _c(doc_id), _c(seq)), F.substring(F.md5(key), 1, 8))


def to_utc(text) -> Column:
    """A timestamp from an ISO-8601 text; null where it cannot be read (the caller keeps the text)."""
    return F.try_to_timestamp(F.regexp_replace(_c(text), "Z$", "+00:00"))
