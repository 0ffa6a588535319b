"""Column helpers of the data model: safe dates, text norms, districts, scores, normal distribution."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronoweave.functions.vocab import DISRUPTIONS, DISTRICTS, RESPONSES, WILDCARDS


def nz(c: Column) -> Column:
    """Empty or blank text counts as absent."""
    return F.nullif(F.trim(c), F.lit(""))


def nz_slot(c: Column) -> Column:
    """Slot 0 counts as absent."""
    return F.nullif(c, F.lit(0))


def safe_date(c: Column) -> Column:
    """ISO date of the first ten characters; null for anything else, '2024' included."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def year_prefix(c: Column) -> Column:
    return F.substring(c, 1, 4)


def quarter(c: Column, absent: str = "_none_") -> Column:
    """Calendar quarter of a date as YYYYQn."""
    return F.coalesce(F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string")), F.lit(absent))


def listify(c: Column) -> Column:
    """An array; a null or empty one becomes ['_none_']."""
    return F.when(F.size(c) > 0, c).otherwise(F.array(F.lit("_none_")))


def _hits(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*map(F.lit, DISTRICTS)), lambda d: F.rlike(low, F.concat(F.lit(r"\b"), d, F.lit(r"\b"))))


def district_first(c: Column) -> Column:
    """The first listed district that the text names, else '_other_'."""
    return F.coalesce(F.get(_hits(c), F.lit(0)), F.lit("_other_"))


def district_unique(c: Column) -> Column:
    """The only district that the text names; '_multi_' for several, '_none_' for none."""
    hits = _hits(c)
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).when(F.size(hits) > 1, F.lit("_multi_")).otherwise(F.lit("_none_"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no such function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def norm_evidence(c: Column) -> Column:
    """NFKC, white space collapsed, trimmed. Texts in ASCII alone skip the Python step."""
    return squeeze(F.when(c.rlike(r"[^\x00-\x7F]"), nfkc(c)).otherwise(c))


def norm_words(c: Column) -> Column:
    """Lower case; anything but letters, digits and underscores is one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def token_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(norm_words(F.coalesce(c, F.lit(""))), " ")), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def publisher_family(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def default_event_id(event_id: Column, article: Column, slot: Column) -> Column:
    return F.coalesce(nz(event_id), F.concat_ws(":llm:event:", article, slot.cast("string")))


def one_line(c: Column) -> Column:
    return F.translate(c, "\t\n", "  ")


def evidence_400(c: Column) -> Column:
    return F.substring(c, 1, 400)


def compatible(a: Column, b: Column) -> Column:
    """Equal commodities, or a wildcard on either side (null is one). Not transitive."""
    wild = lambda c: c.isNull() | c.isin(*WILDCARDS)
    return a.eqNullSafe(b) | wild(a) | wild(b)


def kind_exact(subtype: Column, disruptions: tuple[str, ...] = DISRUPTIONS) -> Column:
    return F.when(subtype.isin(*disruptions), F.lit("disruption")).otherwise(F.lit("response"))


def is_disruption_by_part(types: Column) -> Column:
    """Any known disruption type occurs within the joined type string."""
    return reduce(lambda a, b: a | b, (F.contains(types, F.lit(t)) for t in DISRUPTIONS))


def is_disruption_broad(types: Column) -> Column:
    names = ("Disruption", "DisasterEvent", "PestDiseaseEvent", "SupplyShortage", "FoodSafetyIncident", "WeatherDisruption")
    return reduce(lambda a, b: a | b, (F.contains(types, F.lit(t)) for t in names))


def day_gap(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def recency(lag: Column) -> Column:
    """2 on the day itself, down to 0 after two years."""
    return F.greatest(F.lit(0.0), 2.0 - F.least(lag, F.lit(730)) / 365.0)


def hardness(same_c: Column, compat: Column, same_l: Column, same_s: Column, lag: Column) -> Column:
    return 4.0 * same_c.cast("double") + 2.0 * compat.cast("double") + 1.5 * same_l.cast("double") + 0.5 * same_s.cast("double") + recency(lag)


def district_recency(same: Column, lag: Column) -> Column:
    return 2.0 * same.cast("double") - lag / 10000.0


def cell_score(n: Column, families: Column) -> Column:
    return F.least(n, F.lit(40)) * F.least(families, F.lit(4))


def is_disaster(types: Column) -> Column:
    """Non-empty, and nothing but disasters and weather."""
    return (F.size(types) > 0) & (F.size(F.array_except(types, F.array(F.lit("DisasterEvent"), F.lit("WeatherDisruption")))) == 0)


def json_array_slice(c: Column) -> Column:
    """The text from the first '[' to the last ']' of a reply, without code fences."""
    bare = F.regexp_replace(c, r"```[a-zA-Z]*", "")
    start = F.instr(bare, "[")
    end = F.length(bare) - F.instr(F.reverse(bare), "]") + 1
    return F.when((start > 0) & (end >= start), F.substring(bare, start, end - start + 1))


def kind_problem(kind: Column, subtype: Column) -> Column:
    """Code of a mismatch of kind and subtype, else null."""
    wrong = ((kind == "response") & subtype.isin(*DISRUPTIONS)) | ((kind == "disruption") & subtype.isin(*RESPONSES))
    known = F.coalesce(subtype.isin(*DISRUPTIONS, *RESPONSES), F.lit(False))
    return F.when(F.coalesce(wrong, F.lit(False)), F.lit("V3_kind_subtype_mismatch")).when(~known, F.lit("V3_unknown_subtype"))


def ranking_of(c: Column, n: int | Column) -> Column:
    """All whole numbers in a reply within 1..n, in the order of their first occurrence."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n)))


def describe(mode: str, alias: Column, kind: Column, subtype: Column, commodity: Column, district: Column, date: Column) -> Column:
    """One line about an event: with its words, or with symbols alone."""
    if mode == "lexical":
        return F.concat_ws(" | ", alias, kind, subtype, commodity, district, date.cast("string"))
    return F.concat_ws(" | ", alias, date.cast("string"))


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def default_commodity(c: Column) -> Column:
    return F.coalesce(nz(c), F.lit("unclear"))


def extraction_route(event_id: Column) -> Column:
    return F.split_part(event_id, F.lit(":"), F.lit(2))


def one_hot(c: Column, values: list) -> Column:
    return F.array(*[F.coalesce((c == v).cast("double"), F.lit(0.0)) for v in values])


def scaled_year(date: Column) -> Column:
    return (F.year(date) - 2021) / 6.0


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def cross_entropy(logit: Column, y: Column) -> Column:
    p = sigmoid(logit)
    return -(y * F.log(p + 1e-12) + (1 - y) * F.log(1 - p + 1e-12))


def softmax(x: Column, over) -> Column:
    """Over a window; the maximum is taken off first."""
    e = F.exp(x - F.max(x).over(over))
    return e / F.sum(e).over(over)


def normal_cdf(z: Column) -> Column:
    """Distribution function of the normal law, by a rational approximation (error below 7.5e-8)."""
    # Fixed values of a published five-term approximation.
    b, p = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 0.2316419
    a = F.abs(z)
    t = 1.0 / (1.0 + p * a)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    upper = 0.3989422804014327 * F.exp(-a * a / 2.0) * poly
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def paired_power(n: Column, dz: Column, z: float = 1.959964) -> Column:
    shift = dz * F.sqrt(n)
    return normal_cdf(shift - z) + normal_cdf(-shift - z)


def share(x: Column, n: Column) -> Column:
    return x / F.greatest(n, F.lit(1))


def reporting_lag(published: Column, started: Column) -> Column:
    return F.datediff(published, started)


def entropy(ps: Column, k: int) -> Column:
    """Of an array of probabilities, as a share of the largest possible."""
    import math

    return -F.aggregate(ps, F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.log(p)).otherwise(0.0)) / math.log(k)


def band(p: Column) -> Column:
    return F.when(p < 0.25, F.lit("different")).when(p < 0.5, F.lit("unsure_low")).when(p < 0.75, F.lit("unsure_high")).otherwise(F.lit("same"))


def rule_of_three(n: Column, pool: Column) -> Column:
    """Upper 95 % bound on events in a pool when none was seen among n."""
    return 3.0 / F.greatest(n, F.lit(1)) * pool


def topic(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike(r"(?i)\b(?:" + "|".join(words) + r")\b")


def tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda t: t != "")


def sketch(text: Column, size: int = 5, keep: int = 32) -> Column:
    """The least `keep` hashes of the runs of `size` words; hashes are prefixes of SHA-256."""
    words = F.filter(F.split(norm_words(F.coalesce(text, F.lit(""))), " "), lambda x: x != "")

    def least(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.substring(F.sha2(F.array_join(F.slice(w, i, size), " ").cast("binary"), 256), 1, 16))
        return F.when(F.size(w) >= size, F.slice(F.array_sort(F.array_distinct(hashes)), 1, keep)).otherwise(F.array().cast("array<string>"))

    # the words are bound to a variable; else each run of words would split the text again
    return F.get(F.transform(F.array(words), least), F.lit(0))


def quantile_upper(values: Column, num: int, den: int) -> Column:
    """Element n*num//den of the ascending values, counted from 0; null if there are none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * num / den).cast("int"))


def median_lower(values: Column) -> Column:
    """Element n//2 of the descending values."""
    return F.get(F.sort_array(values, asc=False), F.floor(F.size(values) / 2).cast("int"))
