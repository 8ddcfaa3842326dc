"""Text, URL, period, amount and identity functions as Column expressions (JVM side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.unicode import nfkc, nfkc_casefold


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use() refers to it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- normalisation -----------------------------------------------------------


#: Characters beyond ASCII and the composed Latin-1 letters: only texts with one of them need more than lower().
_OTHERS = r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]"


def fold(text: Column) -> Column:
    """Compatibility composition (NFKC) and case folding of any text. Texts of ASCII and Latin-1 letters stay in the JVM:
    they reach the Arrow function as nulls only."""
    return F.coalesce(nfkc_casefold(F.when(text.rlike(_OTHERS), text)), F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def compatible(text: Column) -> Column:
    """Compatibility composition, case kept."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]"), text)), text)


def collapse(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def normal_key(text: Column) -> Column:
    return collapse(fold(text))


def identity_text(text: Column) -> Column:
    """Compatibility composition and collapsed white space, case kept."""
    return collapse(compatible(text))


#: Fixed value: punctuation of claims.
MARKS = ".,，。;；:：!?！？、()（）[]【】{}《》<>\"'‘’“”"
_MARKS = "[" + "".join("\\" + c if c in "[]().?{}" else c for c in MARKS) + r"\s]+"


def claim_key(text: Column) -> Column:
    """As normal_key, punctuation taken for white space."""
    return F.trim(F.regexp_replace(fold(text), _MARKS, " "))


def edge_key(text: Column) -> Column:
    """As normal_key, without punctuation at the ends."""
    return F.regexp_replace(normal_key(text), f"^{_MARKS}|{_MARKS}$", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", "")


def page_text(text: Column) -> Column:
    """Each line collapsed, blank lines dropped."""
    lines = F.transform(F.split(text, "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def web_text(text: Column) -> Column:
    """Compatibility composition, line ends unified, lines stripped on the right, the whole stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(compatible(text), r"\r\n?", "\n"), r"[ \t]+(?=\n)", ""), r"^\s+|\s+$", "")


# --- tokens and shingles -----------------------------------------------------

CJK = "㐀-鿿"


def terms(text: Column) -> Column:
    """Folded ASCII words, and CJK runs as overlapping pairs of characters (single characters stay). One test a text finds
    out whether there is any CJK."""

    def pairs(run: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))

    def of(low: Column) -> Column:
        both = F.regexp_extract_all(low, F.lit(f"([a-z0-9]+|[{CJK}]+)"), F.lit(1))
        mixed = F.flatten(F.transform(both, lambda t: F.when((F.length(t) > 1) & (F.ascii(t) > 127), pairs(t)).otherwise(F.array(t))))
        return F.when(low.rlike(f"[{CJK}]"), mixed).otherwise(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)))

    return let(fold(text), of)


def term_count(text: Column) -> Column:
    """size(terms()), without building them where there is no CJK."""
    return let(fold(text), lambda low: F.when(low.rlike(f"[{CJK}]"), F.regexp_count(low, F.lit("[a-z0-9]+")) + F.aggregate(F.regexp_extract_all(low, F.lit(f"([{CJK}]+)"), F.lit(1)), F.lit(0), lambda n, run: n + F.greatest(F.lit(1), F.length(run) - 1))).otherwise(F.regexp_count(low, F.lit("[a-z0-9]+"))))


def char_grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text is its own only one."""
    return let(text, lambda t: F.when(F.length(t) > n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; null when both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences, end marks kept; semicolons and Western full stops don't part, line ends do."""
    found = F.regexp_extract_all(text, F.lit("([^。！？!?\n]+[。！？!?]?)"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    """The first of sentences(), null if there is none; the rest of the text isn't parted."""
    return F.nullif(F.trim(F.regexp_extract(text, "[^。！？!?\n ][^。！？!?\n]*[。！？!?]?| [。！？!?]", 0)), F.lit(""))


def clauses(text: Column) -> Column:
    """Parts between full-width end marks and semicolons."""
    return F.filter(F.transform(F.split(text, "[。！？；]"), lambda s: F.trim(s)), lambda s: s != "")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Phrases with ASCII letters must stand between other characters than letters and digits; others anywhere."""
    bounded = F.regexp_like(text, F.concat(F.lit(r"(?<![a-z0-9])\Q"), phrase, F.lit(r"\E(?![a-z0-9])")))
    return F.when(phrase.rlike("[a-z]"), bounded).otherwise(F.contains(text, phrase))


def redact(text: Column, most: int | None = None) -> Column:
    """Bearer tokens and prefixed keys replaced, white space collapsed, cut to `most` characters."""
    out = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "[redacted]")
    out = F.regexp_replace(out, r"(?i)\b(?:sk|tvly|key|token)[-_][A-Za-z0-9_-]{8,}", "[redacted]")
    out = collapse(out)
    return F.substring(out, 1, most) if most else out


def numbers(text: Column) -> Column:
    """Distinct numbers of a claim, model names such as ab-12 left out."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(fold(text), r"[a-z]+[-_]?\d[a-z0-9_-]*", " "), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))))


def model_names(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(fold(text), F.lit(r"([a-z]+[-_]?\d[a-z0-9_-]*)"), F.lit(1))))


# --- URLs --------------------------------------------------------------------


def valid_url(url: Column) -> Column:
    """http or https, a host, no credentials, a port that is a number if any."""
    return F.coalesce(F.regexp_like(url, F.lit(r"(?i)^https?://[^/?#@:\s]+(:\d{1,5})?([/?#].*)?$")), F.lit(False))


def url_host(url: Column) -> Column:
    """Lower-case host without www. and port."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:@\s]+)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or slash at the end; null if not a valid URL."""
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1))
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(F.regexp_replace(host, r":443$", ""))
    path = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(valid_url(url), F.concat(scheme, F.lit("://"), host, path, query))


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: turns 'equal to or a subdomain of' into an equi-join."""
    parts = F.split(host, r"\.")
    return let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), ".")))


# --- identity ----------------------------------------------------------------


def hash_id(prefix: str, *parts: Column, length: int = 32, sep: str = "\0") -> Column:
    """prefix + the first `length` hex digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, length))


def company_id(name: Column) -> Column:
    return hash_id("co_", normal_key(name))


def source_id(kind: Column, external: Column, url: Column, content_hash: Column) -> Column:
    """By external id, else by URL, else (uploads only) by content; null if none is there."""
    by = F.coalesce(
        F.when(F.length(F.trim(external)) > 0, F.concat(F.lit("external:"), kind, F.lit(":"), F.trim(external))),
        F.concat(F.lit("url:"), canonical_url(url)),
        F.when(kind == "uploaded_document", F.concat(F.lit("uploaded_sha256:"), content_hash)),
    )
    return F.concat(F.lit("src_"), F.substring(F.sha2(by, 256), 1, 32))


def version_id(source: Column, content_hash: Column) -> Column:
    return hash_id("sv_", source, content_hash)


def json_id(prefix: str, length: int = 32, **fields: Column) -> Column:
    """Id over a JSON object; fields are laid out by name, so keys are sorted."""
    whole = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    return F.concat(F.lit(prefix), F.substring(F.sha2(whole, 256), 1, length))


# --- periods, amounts, guards ------------------------------------------------


#: The forms of a period after its year, white space left out, and what stands for them.
_PERIODS = (
    (r"度?", ""),
    (r"(?:h1|1半年|上半年)", "-H1"),
    (r"(?:h2|2半年|下半年)", "-H2"),
    (r"(?:q1|第?[一1]季度)", "-Q1"),
    (r"(?:q2|第?[二2]季度)", "-Q2"),
    (r"(?:q3|第?[三3]季度)", "-Q3"),
    (r"(?:q4|第?[四4]季度)", "-Q4"),
)


def normal_period(raw: Column) -> Column:
    """2024, 2024-H1 and 2024-Q3 for a whole text that names a year, half-year or quarter in Western or Chinese form
    (FY2024, 2024年度, 2024年上半年, 2024年第三季度); any other text as edge_key() gives it, null as empty."""

    def of(key: Column) -> Column:
        dense = F.regexp_replace(key, r"\s+", "")
        out = key
        for form, name in reversed(_PERIODS):
            lead = "(?:fy)?" if not name else ""
            pattern = f"^{lead}((?:19|20)[0-9]{{2}})年?{form}$"
            out = F.when(dense.rlike(pattern), F.concat(F.regexp_extract(dense, pattern, 1), F.lit(name))).otherwise(out)
        return out

    return let(F.coalesce(edge_key(raw), F.lit("")), of)


def explicit_period(raw: Column) -> Column:
    return F.coalesce(normal_period(raw).rlike(r"^(19|20)\d{2}(-[HQ][1-4])?$"), F.lit(False))


# --- references, codes, times, rounding --------------------------------------


def safe_ref(ref: Column, prefix: str) -> Column:
    """A model's local reference such as " e1 " as E1; null if it isn't the prefix and a positive number."""
    own = F.upper(F.trim(ref))
    return F.when(own.rlike(f"^{prefix}[1-9][0-9]*$"), own)


def credit_code(text: Column) -> Column:
    """A unified social credit code: eighteen digits and capitals without I, O, S, V, Z; null if it isn't one."""
    own = F.upper(F.regexp_replace(text, r"\s+", ""))
    return F.when(own.rlike(r"^[0-9A-HJ-NP-RT-UW-Y]{18}$"), own)


def iso_time(raw: Column) -> Column:
    """An ISO date or time as a timestamp; one without a zone is UTC; null where there is none."""
    own = F.trim(raw)
    zoned = own.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & own.contains("T")
    return F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(F.when(zoned, own).otherwise(F.concat(own, F.when(own.rlike(r"\d{2}:\d{2}"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))))


def python_round(x: Column, digits: int) -> Column:
    """Rounding of doubles as Python does it: of the exact binary value, halves to even."""
    scale = 10.0**digits
    split = 134217729.0  # 2**27 + 1: parts a double into halves whose products are exact

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * split - (v * split - v)
        return high, v - high

    def of(v: Column) -> Column:
        product = v * scale
        (a, b), (c, d) = halves(v), halves(F.lit(scale))
        error = ((a * c - product) + a * d + b * c) + b * d  # v * scale is product + error, exactly
        low = F.floor(product).cast("double")
        away = product - low - 0.5
        even = F.pmod(low, F.lit(2.0)) == 0
        up = (away > 0) | (away == 0) & ((error > 0) | (error == 0) & ~even)
        near = F.when(up, low + 1).otherwise(low) / scale
        return F.when(F.abs(product) < 2.0**52, near).otherwise(v)

    return let(x.cast("double"), of)


#: Multipliers to the base unit.
UNITS = {"元": ("CNY", 1.0), "万元": ("CNY", 1e4), "亿元": ("CNY", 1e8), "%": ("ratio", 0.01), "ratio": ("ratio", 1.0)}


def amount(value: Column, unit: Column, currency: Column) -> Column:
    """struct(value, unit) in the base unit, to eight decimals; unknown units and other currencies stay as they are."""
    out = F.struct(value.alias("value"), unit.alias("unit"))
    for name, (base, factor) in UNITS.items():
        known = (unit == name) & ((F.lit(base) != "CNY") | F.coalesce(F.upper(currency).isin("CNY", "RMB"), F.lit(True)))
        out = F.when(known, F.struct(F.round(value * F.lit(factor), 8).alias("value"), F.lit(base).alias("unit"))).otherwise(out)
    return out


def valid_score(score: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """score where it is a finite number of the range, else null."""
    x = score.cast("double")
    return F.when(~F.isnan(x) & (x >= low) & (x <= high), x)


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within tolerance; two nulls are equal."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


#: Evidence quality, best first.
QUALITY = ("authoritative_public_record", "first_party", "academic_or_patent", "third_party", "weak_web", "snippet_only")


def quality_rank(category: Column) -> Column:
    out = F.lit(len(QUALITY))
    for i, name in enumerate(QUALITY):
        out = F.when(category == name, F.lit(i)).otherwise(out)
    return out


def source_quality(source_type: Column, scope: Column) -> Column:
    """Category by source type; a search snippet is a snippet whatever its source."""
    return (
        F.when(F.coalesce(scope, F.lit("full_content")) == "search_snippet", "snippet_only")
        .when(source_type.isin("government", "regulatory", "exchange_disclosure", "registry", "standard"), "authoritative_public_record")
        .when(source_type.isin("company_official", "uploaded_document"), "first_party")
        .when(source_type.isin("patent", "paper"), "academic_or_patent")
        .when(source_type == "news", "third_party")
        .otherwise("weak_web")
    )


def distribution(key: str):
    """Aggregate over (key, n) rows: map of key to n, sorted by key."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.col("n")))))
