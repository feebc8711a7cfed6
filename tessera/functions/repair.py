"""Repair, inference, categories, enrichment rules, health and schedules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions.cells import any_of, blank, bound, clamp, clean, has_any, labels, lookup
from tessera.functions.links import parse_date


def without_fragments(text: Column) -> Column:
    """Without the words that are month names or country codes left over in a place."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~F.lower(F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", "")).isin(C.DATE_FRAGMENTS))
    return F.array_join(words, " ")


def is_place(text: Column) -> Column:
    def test(x: Column) -> Column:
        n = F.length(x["text"])
        found = has_any(x["low"], list(C.PLACES)) | any_of(x["text"].rlike(p) for p in C.PLACE_PATTERNS) | (~has_any(x["low"], C.NOT_PLACES) & (n <= 100))
        return F.coalesce((n >= 3) & found, F.lit(False))

    return bound(text, lambda t: bound(F.struct(t.alias("text"), F.lower(t).alias("low")), test))


def repair_location(location: Column, title: Column) -> Column:
    """struct(repaired, value, issue). Words begin with a capital after blanks only, where the text was lower-cased."""
    given = F.struct(location.alias("location"), clean(location).alias("low"), F.coalesce(clean(title), F.lit("")).alias("t"))
    return bound(given, lambda x: _repair_location(x["location"], x["low"], x["t"]))


def _repair_location(location: Column, low: Column, t: Column) -> Column:
    pair = []
    for pattern in C.PLACE_PATTERNS:
        city, country = (without_fragments(F.trim(F.regexp_extract(location, pattern, k))) for k in (1, 2))
        named = bound(F.struct(city.alias("city"), country.alias("country")), lambda x: F.when((F.length(x["city"]) > 2) & (x["country"] != ""), F.concat(x["city"], F.lit(", "), x["country"])))
        pair.append(F.when(location.rlike(pattern), named))

    def out(repaired: bool, value, issue) -> Column:
        return F.struct(F.lit(repaired).alias("repaired"), (value if isinstance(value, Column) else F.lit(value).cast("string")).alias("value"), (issue if isinstance(issue, Column) else F.lit(issue).cast("string")).alias("issue"))

    of_rest = bound(F.trim(F.replace(low, t, F.lit(""))), lambda rest: F.when(is_place(rest), out(True, F.initcap(rest), "Location contained title")).otherwise(out(True, None, "Location was title")))
    of_pair = bound(F.coalesce(*pair), lambda found: out(True, found, F.when(found.isNotNull(), "Location contained job keywords").otherwise("Location was job title")))

    def of_plain(plain: Column) -> Column:
        return F.when(~is_place(plain), out(True, None, "Location invalid after cleaning")).when(plain != location, out(True, plain, "Location contained date fragments")).otherwise(out(False, location, None))

    return (
        F.when(F.coalesce(location == "", F.lit(True)), out(False, None, None))
        .when(low == t, out(True, None, "Location identical to title"))
        .when((F.length(t) > 5) & low.contains(t), of_rest)
        .when(has_any(low, C.NOT_PLACES), of_pair)
        .otherwise(bound(without_fragments(location), of_plain))
    )


def deadline_in_location(location: Column, as_of: date) -> Column:
    """A date after ``as_of`` that stands in a place."""
    patterns = [r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", r"(?i)(\d{1,2}\s+[a-z]{3,9}\s+\d{2,4})", r"(?i)([a-z]{3,9}\s+\d{1,2},?\s+\d{2,4})"]
    return bound(F.coalesce(*[parse_date(F.regexp_extract(location, p, 1)) for p in patterns]), lambda found: F.when(found > F.lit(as_of), found))


def infer_location(description: Column, url: Column, org: Column) -> Column:
    """From the description, then the url's host, then the organisation."""
    host, o, d = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lower(org), F.lower(description)
    return F.coalesce(
        *[F.when(d.contains(k), F.lit(v)) for k, v in C.PLACES.items()],
        *[F.when(has_any(host, words), F.lit(v)) for words, v in C.DOMAIN_PLACES],
        *[F.when(o.contains(k), F.lit(v)) for k, v in C.ORG_PLACES],
    )


def infer_deadline(description: Column, title: Column, url: Column, as_of: date) -> Column:
    """From the description if after ``as_of``, else 30 days on for records with title and url."""
    patterns = [rf"(?i){w}[:\s]+(\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}})" for w in ("deadline", "apply by", "closing")]
    found = [bound(parse_date(F.regexp_extract(description, p, 1)), lambda f: F.when(f > F.lit(as_of), f)) for p in patterns]
    return F.coalesce(*found, F.when((title != "") & (url != ""), F.date_add(F.lit(as_of), 30)))


def clean_title(title: Column) -> Column:
    """Single blanks; apostrophes and quotes that were decoded wrongly."""
    out = F.trim(F.regexp_replace(title, r"\s+", " "))
    for bad, good in (("â€™", "'"), ("â€œ", '"'), ("â€\u009d", '"')):
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def repair(job: dict[str, Column], as_of: date) -> Column:
    """struct(location_raw, deadline, title, repairs) of a record (title, location_raw, deadline date, description, apply_url, org_name)."""
    read = F.when(job["deadline"].isNull(), deadline_in_location(job["location_raw"], as_of))

    def placed(fixed: Column) -> Column:
        location = F.when(fixed["repaired"], fixed["value"]).otherwise(job["location_raw"])
        guess = bound(location, lambda x: F.when(~is_place(x), infer_location(job["description"], job["apply_url"], job["org_name"])))
        return F.struct(fixed["repaired"].alias("repaired"), location.alias("location"), guess.alias("guess"))

    def dated(found: Column) -> Column:
        known = F.coalesce(job["deadline"], found)
        inferred = F.when(known.isNull(), infer_deadline(job["description"], job["title"], job["apply_url"], as_of))
        return F.struct(found.alias("read"), known.alias("known"), inferred.alias("inferred"))

    # Each part is computed once and then named; as plain columns they would be written out, and computed, at each place.
    parts = F.struct(bound(repair_location(job["location_raw"], job["title"]), placed).alias("place"), bound(read, dated).alias("date"), clean_title(job["title"]).alias("title"))

    def record(x: Column) -> Column:
        place, date_, title = x["place"], x["date"], x["title"]
        return F.struct(
            F.coalesce(place["guess"], place["location"]).alias("location_raw"), F.coalesce(date_["known"], date_["inferred"]).alias("deadline"), title.alias("title"),
            labels([(place["repaired"], "location repaired"), (date_["read"].isNotNull(), "deadline found in location"), (place["guess"].isNotNull(), "location inferred"), (date_["inferred"].isNotNull(), "deadline inferred"), (title != job["title"], "title cleaned")]).alias("repairs"),
        )

    return bound(parts, record)


def level_of_experience(label: Column) -> Column:
    """Level of an enrichment label: exact, else the first label of which a part is in the text."""
    low = F.lower(label)
    fuzzy = [F.when(has_any(low, k.lower().split("/")), F.lit(v)) for k, v in C.LEVEL_OF_EXPERIENCE.items()]
    return F.coalesce(lookup(label, C.LEVEL_OF_EXPERIENCE), *fuzzy)


def level_of_grade(text: Column) -> Column:
    """Level of a staff grade: P by number, G, D, then ASG or USG."""
    p = F.regexp_extract(text, r"p-?\s*(\d+)", 1).try_cast("int")
    return F.coalesce(
        F.when(p.isNotNull(), F.when(p <= 2, "Junior / Associate").when(p <= 4, "Officer / Professional").when(p <= 5, "Specialist / Advisor").otherwise("Manager / Senior Manager")),
        F.when(text.rlike(r"g-?\s*\d"), "Junior / Associate"), F.when(text.rlike(r"d-?\s*\d"), "Head / Director"), F.when(text.rlike("asg|usg"), "Executive / Chief"),
    )


def level_of_title(title: Column, description: Column, org_type: Column) -> Column:
    """Level by grade for un and ingo, else by the rule with the highest score, the first among equals.

    A rule scores 10 for its first word in the title, 5 per step of each modifier within three words of it, and 2 if
    the word is in the description too. Of a word that stands in several places, the last one counts.
    """
    t, d = F.lower(title), F.lower(F.coalesce(description, F.lit("")))
    words = F.split(F.trim(t), r"\s+")

    def last(word: str) -> Column:
        at = F.array_max(F.transform(words, lambda w, i: F.when(w.contains(word), i)))
        return at

    scored = []
    for name, keywords, excluded in C.LEVEL_RULES:
        value = F.lit(0)
        for k in reversed(keywords):
            near = sum((F.when(F.abs(last(k) - last(m)) <= 3, s * 5).otherwise(0) for m, s in C.LEVEL_SHIFTS.items() if s), F.lit(0))
            one = 10 + near + F.when(d.contains(k), 2).otherwise(0)
            if k == "officer":
                one = F.when(has_any(t, ["junior", "entry", "assistant", "associate"]), 5).otherwise(one)
            value = F.when(t.rlike(rf"\b{k}\b"), one).otherwise(value)
        scored.append((name, F.when(has_any(t, excluded), None).otherwise(value)))
    best = F.greatest(*[s for _, s in scored])
    by_rule = F.coalesce(*[F.when(s == best, F.lit(n)) for n, s in scored])
    return F.when(F.coalesce(title, F.lit("")) != "", F.coalesce(F.when(org_type.isin("un", "ingo"), level_of_grade(F.trim(F.concat_ws(" ", t, d)))), by_rule))


def job_level(title: Column, description: Column, experience: Column, org_type: Column, current: Column) -> Column:
    """Enrichment label, else title, else what is stored."""
    return F.coalesce(level_of_experience(experience), level_of_title(title, description, org_type), current)


def enrichment_rules(e: dict[str, Column]) -> Column:
    """Applies the confidence rules to an enrichment.

    ``e``: functional_role, sdgs (array<int>), sdg_confidences (map), impact_domain, impact_confidences (map),
    experience_level, experience_confidence, confidence_overall. Operational roles lose their goals; goals need 0.60, at
    most two stay (the surest first, given order kept otherwise), and evidence roles need 0.85 for the best; domains
    need 0.65, experience 0.70, the whole 0.65. Returns struct(sdgs, sdg_confidences, impact_domain,
    impact_confidences, experience_level, experience_confidence, low_confidence, low_confidence_reason).
    """

    def sure(confidences: Column, key: Column) -> Column:
        return F.coalesce(F.element_at(confidences, key.cast("string")), F.lit(0.0))

    def roles(of: list[str]) -> Column:
        return F.coalesce(F.arrays_overlap(e["functional_role"], F.array(*[F.lit(r) for r in of])), F.lit(False))

    operational, evidence = roles(C.OPERATIONAL_ROLES), roles(C.EVIDENCE_ROLES)
    good = F.filter(F.coalesce(e["sdgs"], F.array().cast("array<int>")), lambda s: sure(e["sdg_confidences"], s) >= 0.60)
    ranked = F.transform(F.array_sort(F.transform(good, lambda s, i: F.struct((-sure(e["sdg_confidences"], s)).alias("c"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
    top = F.when(F.size(good) > 2, F.slice(ranked, 1, 2)).otherwise(good)
    best = F.array_max(F.transform(top, lambda s: sure(e["sdg_confidences"], s)))
    too_weak = ~operational & evidence & (F.size(top) > 0) & (best < 0.85)
    sdgs = F.when(operational | too_weak, F.array().cast("array<int>")).otherwise(top)
    had = F.coalesce(F.size(e["impact_domain"]), F.lit(0)) > 0
    domains = F.filter(F.coalesce(e["impact_domain"], F.array().cast("array<string>")), lambda x: sure(e["impact_confidences"], x) >= 0.65)
    confidence = F.coalesce(e["experience_confidence"], F.lit(0.0))
    vague = (F.coalesce(e["experience_level"], F.lit("")) != "") & (confidence < 0.70)
    overall = F.coalesce(e["confidence_overall"], F.lit(0.0))
    reasons = labels([
        (operational, "operational/support role"),
        (too_weak, "MEAL role requires SDG confidence >= 0.85"),
        (had & (F.size(domains) == 0), "all impact_domains below confidence threshold (0.65)"),
        (vague, F.format_string("experience_level confidence %.2f < 0.70", confidence)),
        (overall < 0.65, F.format_string("overall confidence %.2f < 0.65", overall)),
    ])
    return F.struct(
        sdgs.alias("sdgs"),
        F.map_filter(F.coalesce(e["sdg_confidences"], F.create_map().cast("map<string,double>")), lambda k, v: F.array_contains(F.transform(sdgs, lambda s: s.cast("string")), k)).alias("sdg_confidences"),
        domains.alias("impact_domain"),
        F.map_filter(F.coalesce(e["impact_confidences"], F.create_map().cast("map<string,double>")), lambda k, v: F.array_contains(domains, k)).alias("impact_confidences"),
        F.when(~vague, e["experience_level"]).alias("experience_level"),
        F.when(~vague, e["experience_confidence"]).alias("experience_confidence"),
        (F.size(reasons) > 0).alias("low_confidence"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).alias("low_confidence_reason"),
    )


def review_reasons(overall: Column, experience: Column, domains: Column, low: Column) -> Column:
    """Why an enrichment goes to review; empty if it does not."""
    best = F.array_max(F.map_values(domains))
    return labels([
        (F.coalesce(overall, F.lit(1.0)) < 0.60, F.format_string("overall confidence %.2f < 0.60", overall)),
        ((experience != 0) & (experience < 0.65), F.format_string("experience confidence %.2f < 0.65", experience)),
        (best < 0.70, F.format_string("max impact_domain confidence %.2f < 0.70", best)),
        (F.coalesce(low, F.lit(False)), "low_confidence flag set"),
    ])


def valid_enrichment(e: dict[str, Column], domains: list[str], roles: list[str], levels: list[str]) -> Column:
    """Values in the canonical sets only, goals 1 to 17, confidences within 0 and 1."""

    def known(c: Column, of: list[str]) -> Column:
        return F.array_intersect(c, F.array(*[F.lit(x) for x in of]))

    def sane(m: Column) -> Column:
        return F.map_filter(m, lambda k, v: v.between(0.0, 1.0))

    return F.struct(
        known(e["impact_domain"], domains).alias("impact_domain"), known(e["functional_role"], roles).alias("functional_role"),
        F.when(e["experience_level"].isin(levels), e["experience_level"]).alias("experience_level"),
        F.filter(e["sdgs"], lambda s: s.between(1, 17)).alias("sdgs"), sane(e["impact_confidences"]).alias("impact_confidences"), sane(e["sdg_confidences"]).alias("sdg_confidences"),
    )


def scaled(confidences: Column, input_quality: Column) -> Column:
    """Confidences times the input's quality where that is below 0.7."""
    return F.transform_values(confidences, lambda k, v: F.when(input_quality < 0.7, v * input_quality).otherwise(v))


def embedding_input(title: Column, org: Column, description: Column, keywords: Column) -> Column:
    return F.concat_ws(" | ", *[F.when(~blank(c), c) for c in (title, org, F.substring(description, 1, 500))], F.array_join(F.slice(keywords, 1, 5), " | "))


def title_case(title: Column) -> Column:
    """Capitals at word begins; words in capitals or with one inside stay."""
    words = F.filter(F.split(F.trim(title), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^.+\p{Lu}"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))), " ")


def enhanced(description: Column, url: Column, org: Column) -> Column:
    """Single blanks, a pointer to the url where short, and the organisation in front where it is not named."""
    d = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " "))
    d = F.when((F.length(d) < 50) & ~F.coalesce(url == "", F.lit(True)), F.concat(d, F.lit(" [Full description available at: "), url, F.lit("]"))).otherwise(d)
    named = F.coalesce(org == "", F.lit(True)) | F.lower(d).contains(F.lower(org))
    return F.trim(F.when(named, d).otherwise(F.concat(F.lit("Organization: "), org, F.lit(". "), d)))


def input_quality(description: Column, org: Column, location: Column) -> Column:
    n = F.coalesce(F.length(description), F.lit(0))
    base = F.when(n < 50, 0.5).when(n < 100, 0.7).when(n < 200, 0.9).otherwise(1.0)
    return base * F.when(F.coalesce(org == "", F.lit(True)), 0.9).otherwise(1.0) * F.when(F.coalesce(location == "", F.lit(True)), 0.95).otherwise(1.0)


def reliability(n_logs: Column, n_ok: Column, failures: Column) -> Column:
    f = F.coalesce(failures, F.lit(0))
    none = F.greatest(F.lit(0.0), 70.0 - f * 15)
    return F.when(F.coalesce(n_logs, F.lit(0)) == 0, none).otherwise(clamp(F.try_divide(n_ok * 100.0, n_logs) - f * 10, 0.0, 100.0))


def activity(found: Column, inserted: Column, updated: Column) -> Column:
    changes, found = F.coalesce(inserted, F.lit(0)) + F.coalesce(updated, F.lit(0)), F.coalesce(found, F.lit(0)).cast("double")
    rate = changes / F.greatest(F.lit(1.0), found / F.greatest(F.lit(1), changes))
    return F.when(found == 0, 0.0).when(rate >= 10, 100.0).when(rate >= 1, 50.0 + rate * 5).otherwise(rate * 50.0)


def url_quality(total: Column, no_url: Column, listing: Column) -> Column:
    """Share of stored records without fault, 50 where there are none."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, 50.0).otherwise(clamp(100.0 - F.try_divide((no_url + listing) * 100.0, total), 0.0, 100.0))


def health(reliability_: Column, activity_: Column, quality_: Column, org_type: Column, engagement: float = 50.0) -> Column:
    """struct(score, priority, frequency_days) from the four components, weighted .35, .30, .20 and .15."""
    score = reliability_ * 0.35 + activity_ * 0.30 + quality_ * 0.20 + engagement * 0.15
    org = F.lower(F.coalesce(org_type, F.lit("")))
    priority = 5 + F.when(score >= 80, 2).when(score >= 60, 1).when(score < 30, -2).otherwise(0) + F.when(activity_ >= 70, 1).when(activity_ < 20, -1).otherwise(0) + F.when(org.isin("un", "ingo"), 1).otherwise(0)
    base = F.coalesce(lookup(org, C.RUN_DAYS), F.lit(3)).cast("double")
    days = F.when((score >= 80) & (activity_ >= 70), F.greatest(F.lit(0.5), base - 1)).when((score < 50) | (activity_ < 30), F.least(F.lit(14.0), base + 2)).otherwise(base)
    return F.struct(F.bround(score, 2).alias("score"), F.greatest(F.lit(1), F.least(F.lit(10), priority)).alias("priority"), F.bround(days, 1).alias("frequency_days"))


def next_run_days(base: Column, org_type: Column, changes: Column, failures: Column, unchanged: Column, score: Column | None = None, activity_: Column | None = None, recommended: Column | None = None, jitter_key: Column | None = None) -> Column:
    """Days to the next run. With ``jitter_key`` the result is spread by up to 15 % by its hash."""
    start = F.coalesce(F.when(base > 0, base), lookup(org_type, C.RUN_DAYS), F.lit(3)).cast("double")
    days = (
        F.when(changes >= 20, F.greatest(F.lit(0.25), start - 2))
        .when(changes >= 10, F.greatest(F.lit(0.5), start - 1))
        .when(changes >= 5, F.greatest(F.lit(0.5), start - 0.5))
        .when((changes == 0) & (unchanged >= 5), F.least(F.lit(21.0), start + 3))
        .when((changes == 0) & (unchanged >= 3), F.least(F.lit(14.0), start + 1))
        .otherwise(start)
    )
    wait = F.least(F.lit(7.0), F.pow(F.lit(2.0), F.least(failures, F.lit(4))) * 6 / 24)
    days = F.when(failures > 0, F.greatest(days, wait)).otherwise(days)
    if score is not None:
        days = F.when((score >= 80) & (activity_ >= 70), F.greatest(F.lit(0.5), days - 0.5)).when(score < 50, F.least(F.lit(14.0), days + 1)).otherwise(days)
        days = F.when(F.abs(recommended - days) > 2, recommended).otherwise(days)
    if jitter_key is not None:
        days = days * (0.85 + F.pmod(F.xxhash64(jitter_key), F.lit(1000)) / 999 * 0.3)
    return days


def counters(status: Column, changes: Column, failures: Column, unchanged: Column) -> Column:
    """struct(failures, unchanged, status) after a run: failures add up until a success, runs without change until one changes; five failures pause."""
    failed = status != "ok"
    f = F.when(failed, failures + 1).otherwise(0)
    return F.struct(f.alias("failures"), F.when(failed, unchanged).when(changes == 0, unchanged + 1).otherwise(0).alias("unchanged"), F.when(f >= 5, "paused").otherwise("active").alias("status"))


def location_kind(location: Column) -> Column:
    """remote, onsite, or null for several places, which words alone do not settle."""
    return F.when(has_any(F.lower(location), ["remote", "work from home", "wfh", "virtual", "online"]), "remote").when(~location.rlike("[/;,]"), "onsite")


def salary_range(text: Column) -> Column:
    """struct(min, max, currency) of a range such as $50,000 - $70,000; null if there is none."""
    pattern = r"\$?([\d,]+)\s*[-–—]\s*\$?([\d,]+)"
    low, high = (F.replace(F.regexp_extract(text, pattern, k), F.lit(","), F.lit("")).try_cast("long") for k in (1, 2))
    code, sign = F.regexp_extract(F.upper(text), r"([A-Z]{3})|([$€£¥])", 1), F.regexp_extract(F.upper(text), r"([A-Z]{3})|([$€£¥])", 2)
    currency = F.coalesce(F.when(code != "", code), lookup(sign, {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}), F.lit("USD"))
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(low.alias("min"), high.alias("max"), currency.alias("currency")))
