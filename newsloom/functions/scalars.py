"""Column functions: URLs, hashes, identities, scores, decays and labels. None raises on malformed input."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import vocab as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_pattern(words: list[str]) -> str:
    """One alternation of literal words; matches nothing where there are none."""
    return "|".join(re.escape(w) for w in words) or r"(?!)"


def has_low(low: Column, words: list[str]) -> Column:
    """Whether a text in lower case contains any of the words; few of them are looked up as they are, many by one pattern."""
    words = [w.lower() for w in words]
    if not 0 < len(words) <= 8:
        return low.rlike(words_pattern(words))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the text contains any of the words, without regard to case."""
    return has_low(F.lower(text), words)


def occurrences(text: Column, word: str) -> Column:
    """How often the word is in the text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def mapped(key: Column, table: dict, default) -> Column:
    """The table's value of key, or default."""
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(literal, key), F.lit(default))


def normalize_url(url: Column | str) -> Column:
    """Trimmed, without trailing slash, fragment, path parameters and tracking keys of the query."""
    u = F.regexp_replace(F.trim(col(url)), "/+$", "")
    parts = lambda k: F.regexp_extract(u, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", k)
    path = F.regexp_replace(F.regexp_replace(parts(3), r";[^/]*$", ""), "/+$", "")
    dropped = "^(?:" + words_pattern(V.DROPPED_QUERY_KEYS) + ")"
    query = F.array_join(F.filter(F.split(parts(4), "&"), lambda p: p.contains("=") & ~p.endswith("=") & ~p.rlike(dropped)), "&")
    head = F.when(parts(1) != "", F.concat(F.lower(parts(1)), F.lit(":"))).otherwise("")
    host = F.when(parts(2) != "", F.concat(F.lit("//"), parts(2))).otherwise("")
    return F.when(u == "", u).otherwise(F.concat(head, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def url_hash(url: Column | str) -> Column:
    return F.md5(normalize_url(url))


def fingerprint(title: Column | str, source: Column | str) -> Column:
    """First 16 digits of the SHA-1 of the title's first 80 characters and the source, trimmed; a null counts as empty."""
    text = lambda c: F.coalesce(col(c), F.lit(""))
    key = F.lower(F.concat(F.substring(text(title), 1, 80), F.lit("|"), text(source)))
    return F.substring(F.sha1(F.regexp_replace(key, r"(?U)^\s+|\s+$", "")), 1, 16)


def valid_url(url: Column | str) -> Column:
    u = col(url)
    return F.coalesce(
        u.rlike(r"^https?://") & ~F.lower(u).rlike(words_pattern(["xxxx", "placeholder", "example.com/test"])) & ~u.rlike(r"/a-\d+"),
        F.lit(False)
    )


def _code(text: Column) -> Column:
    return F.replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit("_"))


def identity_key(event_type: Column, actors: Column, location: Column, obj: Column) -> Column:
    """TYPE|ACTORS|LOCATION|OBJECT: mapped type, the first three distinct upper-case actors in order, coded places."""
    kind = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in V.EVENT_TYPES.items() for x in kv]), event_type),
        F.replace(F.upper(event_type), F.lit(" "), F.lit("_"))
    )
    names = F.array_sort(F.array_distinct(F.filter(
        F.transform(F.coalesce(actors, F.array().cast("array<string>")), lambda a: F.upper(F.trim(a))), lambda a: a != ""
    )))
    return F.concat_ws("|", F.coalesce(kind, F.lit("")), F.array_join(F.slice(names, 1, 3), ","), _code(location), _code(obj))


def event_id(key: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(key, 256), 1, 8))


def extract_codes(title: Column, names: list[tuple[str, str]], limit: int, without: list[str] | None = None) -> Column:
    """Codes of the (name, code) pairs whose name is in the title, longest name first, distinct, at most limit.

    Short Latin names need a non-letter on each side. Pairs whose name is in `without` are skipped.
    """
    ordered = sorted((p for p in names if p[0] not in (without or [])), key=lambda p: (-len(p[0]), names.index(p)))

    def found(name: str) -> Column:
        if re.fullmatch(r"[\x00-\x7F]+", name) and len(name) < 3:
            return title.rlike(r"(?i)(?<!\p{L})" + re.escape(name) + r"(?!\p{L})")
        return F.lower(title).contains(name.lower())

    hits = F.array(*[F.when(found(n), F.lit(c)) for n, c in ordered]) if ordered else F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.array_compact(hits)), 1, limit)


def slugify(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"(?U)[^\w]+", "-"), "^-+|-+$", "")


def derive_identity(title: Column, actors: Column, phase: Column, domains: Column, entities: list, actions: list) -> Column:
    """The identity key of an event: entities of the title else actors; phase else first domain; second domain; action else slug."""
    named = extract_codes(title, entities, 3)
    who = F.when(F.size(named) > 0, named).otherwise(actors)
    kind = F.coalesce(F.nullif(F.upper(phase), F.lit("")), _code(F.get(domains, 0)), F.lit("GEOPOLITICAL"))
    did = F.get(extract_codes(title, actions, 2), 0)
    slug = F.upper(F.regexp_replace(F.regexp_replace(F.substring(title, 1, 40), r"(?U)[^\w]+", "_"), "^_+|_+$", ""))
    return identity_key(
        F.coalesce(F.nullif(kind, F.lit("")), F.lit("GEOPOLITICAL")), who, F.substring(_code(F.get(domains, 1)), 1, 30),
        F.coalesce(did, slug)
    )


def canonical_event_id(title: Column, entities: list, actions: list, topics: list, aliases: list[tuple[str, int, list[str], list[str]]]) -> Column:
    """Codes of the title joined where there are two or more; else the first alias by priority; else a slug and a hash.

    aliases: (canonical, priority, keywords, excluded words).
    """
    used = [n for n, _ in entities] + [n for n, _ in actions]
    codes = F.concat(extract_codes(title, entities, 2), extract_codes(title, actions, 1), extract_codes(title, topics, 1, used))
    slug = F.concat(F.substring(slugify(title), 1, 30), F.lit("-"), F.substring(F.md5(title), 1, 8))
    alias = F.lit(None).cast("string")
    for name, _, words, excluded in sorted(aliases, key=lambda a: (a[1], -aliases.index(a))):
        alias = F.when(has_any(title, words) & ~has_any(title, excluded), slugify(F.lit(name))).otherwise(alias)
    return F.when(F.size(codes) >= 2, F.lower(F.array_join(codes, "-"))).otherwise(F.coalesce(alias, slug))


def parsed_time(text: Column | str) -> Column:
    """The first format that fits, as a timestamp; null where none does."""
    t = F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"^[A-Za-z]{3,9},\s*", ""), r"\s+(?:GMT|UTC)$", " +0000")
    formats = (
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX", "dd MMM yyyy HH:mm:ss xx",
        "dd MMM yyyy HH:mm:ss"
    )
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def hours_between(then: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of) - F.unix_timestamp(then)) / 3600.0


def time_decay(ts: Column, as_of: Column, half_life: float = 72) -> Column:
    """Halves every half_life hours, from 1 down to 0.1; 1 without a time or with one to come."""
    h = F.greatest(F.lit(0.0), hours_between(ts, as_of))
    return F.coalesce(F.greatest(F.lit(0.1), F.exp(-0.693 * h / (half_life if half_life > 0 else 72))), F.lit(1.0))


def signal_decay(first_seen: Column, level: Column, as_of: Column, half_life: float = 48) -> Column:
    """The level's rate to the power of elapsed half-lives, at least 0.1, three digits."""
    h = hours_between(first_seen.cast("timestamp"), as_of)
    return F.coalesce(
        F.when(h <= 0, 1.0).otherwise(F.greatest(F.lit(0.1), F.round(F.pow(mapped(level, V.LEVEL_RATES, 0.80), h / half_life), 3))),
        F.lit(1.0)
    )


def estimate_risk(level: Column, phase: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), mapped(level, V.RISK_BASE, 25) + mapped(phase, V.PHASE_BONUS, 0)))


def estimate_confidence(c: Column) -> Column:
    return mapped(F.lower(c), V.CONFIDENCE, 0.6)


def infer_region(domains: Column) -> Column:
    return F.coalesce(F.get(F.filter(domains, lambda d: d.isin(V.REGIONS)), 0), F.lit("全球"))


def infer_type(domains: Column, phase: Column) -> Column:
    return F.coalesce(F.get(F.filter(domains, lambda d: d.isin(list(V.EVENT_TYPES))), 0), mapped(phase, V.PHASE_TYPES, "政治"))


def detect_phase(current: Column, text: Column, rules=V.PHASE_RULES) -> Column:
    """The phase that the first rule with a word in the text leads to, if it can follow the current one."""
    out = current
    for new, words, after in reversed(rules):
        out = F.when(has_any(text, words), F.when(current.isin(after), F.lit(new)).otherwise(current) if after else F.lit(new)).otherwise(out)
    return out


def phase_change(current: Column, text: Column, deltas: dict[tuple[str, str], int], rules=V.PHASE_RULES) -> Column:
    """(phase, risk_delta, transition): the phase after the text, the delta of that step (0 for one without) and its
    text; no text where the delta is 0."""
    new = detect_phase(current, text, rules)
    delta = mapped(F.concat_ws("→", current, new), {f"{a}→{b}": d for (a, b), d in deltas.items()}, 0)
    shown = F.concat(current, F.lit(" → "), new, F.lit(" (风险增量: "), F.when(delta > 0, "+").otherwise(""), delta.cast("string"), F.lit(")"))
    return F.struct(new.alias("phase"), delta.alias("risk_delta"), F.when(delta != 0, shown).otherwise("").alias("transition"))


def normalize_theme(text: Column, themes=V.THEMES, other: str = V.OTHER_THEME) -> Column:
    return reduce(lambda rest, t: F.when(text.rlike(f"(?i){t[0]}"), F.lit(t[1])).otherwise(rest), reversed(themes), F.lit(other))


def classify_lean(source: Column, leans=V.LEANS, local: str = V.LOCAL_LEAN) -> Column:
    return reduce(lambda rest, t: F.when(has_any(source, t[1]), F.lit(t[0])).otherwise(rest), reversed(leans), F.lit(local))


def confirmation(
    text: Column, source: Column, coverage: Column, official: list[str], social: list[str], multipliers=(1.5, 1.3, 0.5, 0.8),
    min_sources: int = 3
) -> Column:
    """Multiplier of an official statement, of several sources, of social media, of one source; the first that holds."""
    return confirmed(has_any(text, official), source, coverage, social, multipliers, min_sources)


def confirmed(
    official: Column, source: Column, coverage: Column, social: list[str], multipliers=(1.5, 1.3, 0.5, 0.8), min_sources: int = 3
) -> Column:
    """confirmation() where it is known whether the text has an official statement."""
    a, b, c, d = multipliers
    return F.when(official, a).when(coverage >= min_sources, b).when(has_any(source, social), c).otherwise(d)


def run_quality(r: dict[str, Column] | None = None) -> Column:
    """0 to 100 from a run's columns (those of the runs table)."""
    c = lambda n: (r or {}).get(n, F.col(n))
    when = lambda cond, x: F.when(cond, x).otherwise(0)
    plus = F.when(c("regions_covered") >= 10, 10).when(c("regions_covered") >= 8, 5).otherwise(0) + when(c("h2_chapters") >= 10, 5) + when(c("placeholder_count") == 0, 10) + when(c("vague_count") == 0, 5)
    plus = plus + when(c("json_parse_success"), 10) + F.when(c("citation_density") > 0.8, 10).when(c("citation_density") > 0.5, 5).otherwise(0) + when(c("s_level_count") <= 1, 5) + when(c("a_level_count") <= 5, 5)
    minus = when(c("had_fallback"), 15) + when(c("had_truncation"), 10) + when(c("had_parse_error"), 10) + when(c("source_success_rate") < 0.7, 10)
    return F.greatest(F.lit(0), F.least(F.lit(100), 50 + plus - minus))


def benchmark_subscores() -> dict[str, Column]:
    """Nine part scores of a run; their sum is the total."""
    c, zero = F.col, F.lit(0.0)
    signal = 15.0 - F.greatest(zero, (c("s_level_count") - 1) * 5.0) - F.greatest(zero, (c("a_level_count") - 5) * 2.0)
    stable = 5.0 - F.when(c("had_fallback"), 3).otherwise(0) - F.when(c("had_truncation"), 2).otherwise(0) - F.when(c("had_parse_error"), 2).otherwise(0)
    return {
        "regions": F.least(c("regions_covered") / 12.0 * 15, F.lit(15.0)),
        "chapters": F.least(c("h2_chapters") / 10.0 * 10, F.lit(10.0)),
        "cleanliness": F.greatest(zero, 15.0 - c("placeholder_count") * 5 - c("vague_count") * 3),
        "json": F.when(c("json_parse_success"), 10.0).otherwise(0.0),
        "citation": F.least(c("citation_density") * 10.0, F.lit(10.0)),
        "signal_accuracy": F.greatest(zero, signal),
        "latency": F.when(c("total_seconds") < 180, 10.0).when(c("total_seconds") < 600, 10.0 * (600 - c("total_seconds")) / 420).otherwise(0.0),
        "token_efficiency": F.when(c("total_tokens") < 50000, 10.0).when(c("total_tokens") < 100000, 7.0).otherwise(3.0),
        "stability": F.greatest(zero, stable),
    }


def grade(total: Column) -> Column:
    return F.when(total >= 90, "A").when(total >= 80, "B").when(total >= 70, "C").when(total >= 60, "D").otherwise("F")


def est_tokens(text: Column, div: int = 3) -> Column:
    return F.floor(F.length(text) / div)


def freshness_label(quality: Column, hours: Column, limit: float = 72) -> Column:
    return F.when((hours > limit) & (quality != "verified"), "stale").otherwise(quality)


def redact_paths(text: Column, n: int = 300) -> Column:
    """File paths replaced by <path>, and the result cut to n characters."""
    return F.substring(F.regexp_replace(text, r"(?:[A-Za-z]:\\|/)(?:[\w.-]+[/\\])+[\w.-]*", "<path>"), 1, n)


def consensus(n: Column) -> Column:
    return F.when(n > 5, "高").when(n > 1, "中").otherwise("低")


def arrow(x: Column) -> Column:
    return F.when(x > 0, "↑").when(x < 0, "↓").otherwise("→")
