"""Text functions: cleaning, identity keys, tokens, sections, contacts. Columns in, columns out; null counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import dictionaries as D
from tessera.functions.seen import Seen

TOKEN = r"[a-z0-9+#.]+"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f names it: conditions and lambdas would evaluate it again in each branch."""
    return F.transform(F.array(c), f)[0]


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def strip_html(c: Column | str) -> Column:
    """Each tag becomes one space, and so does &nbsp;; other entities and inner spaces stay."""
    return strip(F.replace(F.regexp_replace(text(c), "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" ")))


def content_hash(company: Column | str, title: Column | str, description: Column | str) -> Column:
    part = lambda c: F.lower(strip(c))
    return F.sha2(F.concat_ws("|", part(company), part(title), part(F.substring(text(description), 1, 500))), 256)


def identity_key(url: Column | str, company: Column | str, title: Column | str) -> Column:
    """The address without its query, else company and title."""
    u = F.lower(strip(url))
    path = F.regexp_replace(F.split_part(u, F.lit("?"), F.lit(1)), "/+$", "")
    return F.when(u.startswith("http"), F.concat(F.lit("url:"), path)).otherwise(F.concat(F.lit("ct:"), F.lower(strip(company)), F.lit("|"), F.lower(strip(title))))


def absolute_url(url: Column | str, base: str = "") -> Column:
    """Absolute addresses stay; others are put under base, or are empty without one."""
    u, base = strip(url), base.strip()
    under = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(u, "^/+", "")) if base else F.lit("")
    return F.when(u == "", "").when(u.rlike("^https?://"), u).otherwise(under)


def search_url(company: Column | str, title: Column | str) -> Column:
    query = F.url_encode(strip(F.concat_ws(" ", text(title), text(company), F.lit("job apply"))))
    return F.concat(F.lit("https://www.google.com/search?q="), F.replace(F.replace(query, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def apply_url(url: Column | str, company: Column | str, title: Column | str, base: str = "") -> Column:
    found = absolute_url(url, base)
    return F.when(found != "", found).otherwise(search_url(company, title))


def bare_url(url: Column | str) -> Column:
    """Scheme and host in lower case, no trailing slash, no query or fragment; search links are empty."""
    u = strip(url)
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1), "/+$", "")
    return F.when((u == "") | F.lower(u).contains("google.com/search"), "").when(host == "", F.lower(u)).otherwise(F.concat(scheme, F.lit("://"), host, path))


def fingerprint(title: Column | str, company: Column | str, description: Column | str, posted: Column | str) -> Column:
    blob = F.lower(F.concat_ws("|", text(title), text(company), F.substring(text(description), 1, 800), text(posted)))
    return F.substring(F.sha2(strip(F.regexp_replace(blob, r"\s+", " ")), 256), 1, 24)


def tokens(c: Column | str) -> Column:
    """Lower-case tokens of two characters at least, in order."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN.removesuffix("+") + "{2,}"), F.lit(0))


def has_word(c: Column | Seen, word: str) -> Column:
    """The word as a whole, also beside letters outside ASCII."""
    return c.word(word) if isinstance(c, Seen) else c.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){escaped(word)}([^\p{{L}}\p{{N}}_]|$)")


def escaped(word: str) -> str:
    return "".join("\\" + c if c in r".+*?()[]{}|^$\\-" else c for c in word)


def remote_policy(description: Column | str, location: Column | str) -> Column:
    hay = F.lower(F.concat_ws(" ", text(description), text(location)))
    found = F.regexp_extract(hay, D.REMOTE_POLICY, 1)
    return F.when(found != "", found).when(hay.contains("remote"), "remote").otherwise("")


def employment_type(description: Column | str, title: Column | str) -> Column:
    return F.regexp_extract(F.lower(F.concat_ws(" ", text(title), text(description))), D.EMPLOYMENT, 1)


def listing_sections(c: Column | str) -> Column:
    """struct<body, requirements, nice>: lines under a header belong to its section."""
    kind = "struct<mode:string,body:array<string>,requirements:array<string>,nice:array<string>>"
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("body").alias("mode"), none.alias("body"), none.alias("requirements"), none.alias("nice")).cast(kind)

    def step(acc: Column, line: Column) -> Column:
        bare = strip(line)
        mode = F.when(bare.rlike(D.REQUIREMENTS_HEADER), "requirements").when(bare.rlike(D.NICE_HEADER), "nice")
        put = lambda name: F.when(mode.isNull() & (acc["mode"] == name), F.concat(acc[name], F.array(line))).otherwise(acc[name]).alias(name)
        return F.struct(F.coalesce(mode, acc["mode"]).alias("mode"), put("body"), put("requirements"), put("nice")).cast(kind)

    join = lambda acc, name: strip(F.array_join(acc[name], "\n")).alias(name)
    return F.aggregate(F.split(text(c), r"\r\n|\r|\n"), start, step, lambda acc: F.struct(join(acc, "body"), join(acc, "requirements"), join(acc, "nice")))


def resume_sections(c: Column | str) -> Column:
    """map of header to body; lines before any header are under `header`."""
    kind = "struct<at:string,found:map<string,array<string>>>"
    start = F.struct(F.lit("header").alias("at"), F.create_map(F.lit("header"), F.array().cast("array<string>")).alias("found")).cast(kind)

    def step(acc: Column, line: Column) -> Column:
        bare = strip(line)
        head = bare.rlike(D.RESUME_HEADER)
        at = F.when(head, F.lower(F.regexp_replace(bare, ":+$", ""))).otherwise(acc["at"])
        lines = F.when(head, F.array().cast("array<string>")).otherwise(F.concat(acc["found"][acc["at"]], F.array(line)))
        rest = F.map_filter(acc["found"], lambda k, v: k != at)
        return F.struct(at.alias("at"), F.map_concat(rest, F.create_map(at, lines)).alias("found")).cast(kind)

    bodies = lambda acc: F.transform_values(F.map_filter(acc["found"], lambda k, v: F.size(v) > 0), lambda k, v: strip(F.array_join(v, "\n")))
    return F.aggregate(F.split(text(c), r"\r\n|\r|\n"), start, step, bodies)


def contacts(c: Column | str) -> Column:
    """struct<email, phone, linkedin_url, github_url, portfolio_url>: the first of each, empty if there is none."""
    t = text(c)
    first = lambda items: F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))
    urls = F.regexp_extract_all(t, F.lit(D.URL), F.lit(0))
    full = lambda u: F.when((u == "") | u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))
    has = lambda word: first(F.filter(urls, lambda u: F.lower(u).contains(word)))
    other = first(F.filter(urls, lambda u: ~F.lower(u).contains("linkedin") & ~F.lower(u).contains("github")))
    return F.struct(
        first(F.regexp_extract_all(t, F.lit(D.EMAIL), F.lit(0))).alias("email"),
        first(F.regexp_extract_all(t, F.lit(D.PHONE), F.lit(0))).alias("phone"),
        full(has("linkedin")).alias("linkedin_url"),
        full(has("github")).alias("github_url"),
        full(other).alias("portfolio_url"),
    )


def json_salvage(c: Column | str) -> Column:
    """The JSON text in a reply: what a fence holds if it parses, else the outermost brackets, mended; null if neither parses."""
    t = strip(c)
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(fence != "", strip(fence)).otherwise(t)
    span = F.regexp_extract(inner, r"(?s)[\{\[].*[\}\]]", 0)
    mended = F.regexp_replace(F.regexp_replace(span, r",\s*([}\]])", "$1"), r"[\x00-\x1f]", " ")
    parses = lambda s: F.try_parse_json(s).isNotNull()
    return F.when(parses(inner), inner).when((span != "") & parses(mended), mended)


def challenge_hits(c: Column | str) -> Column:
    sample = F.substring(text(c), 1, 8000)
    hits = [F.when(sample.rlike("(?i)" + p), 1).otherwise(0) for p in D.CHALLENGE_PATTERNS]
    return sum(hits[1:], hits[0])


def is_challenge(c: Column | str, status: Column | None = None) -> Column:
    """A page that asks for proof of a human: any pattern on a short or refused page, two on others."""
    hits = challenge_hits(c)
    blocked = F.coalesce(status.isin(403, 429, 503), F.lit(False)) if status is not None else F.lit(False)
    return F.when((F.length(text(c)) < 2500) | blocked, hits >= 1).otherwise(hits >= 2)


def dedup_words(c: Column | str) -> Column:
    """Items that aren't blank, stripped, the first of those that differ only in case."""
    items = F.filter(F.transform(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")), strip), lambda s: s != "")
    first = lambda own: once(F.transform(own, F.lower), lambda low: F.filter(own, lambda s, k: F.array_position(low, F.get(low, k)) == k + 1))
    return once(items, first)


def recommendation(c: Column | str) -> Column:
    t = F.lower(text(c))
    return F.when(t.contains("highly"), "Highly Recommended").when(t.contains("skip"), "Skip").otherwise("Consider")


def short_reason(reasons: Column, recommended: Column) -> Column:
    """The first reason, cut to 160 characters, else the recommendation."""
    first = strip(F.try_element_at(reasons, F.lit(1)))
    cut = F.when(F.length(first) > 160, F.concat(F.regexp_replace(F.substring(first, 1, 159), r"\s+$", ""), F.lit("…"))).otherwise(first)
    return F.when(first != "", cut).otherwise(text(recommended))


def redacted_url(c: Column | str) -> Column:
    """Without the user and password before the host."""
    return F.regexp_replace(text(c), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]+@", "$1***@")


def safe_filename(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(strip(c), r"[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 60)


def model_size(c: Column | str) -> Column:
    """Billions of parameters that a model tag names."""
    size = F.regexp_extract(F.lower(strip(c)), r"(?:^|[^0-9.])(70|72|34|33|32|27|22|14|13|9|8|7|3|1\.?5)b\b", 1)
    return F.when(size == "", F.lit(None)).when(size.isin("1.5", "15"), 2.0).otherwise(size.cast("double"))


def _prefixed(c: Column | str, model: Column, prefix: str) -> Column:
    name = F.lower(model)
    return F.concat(F.when(name.contains("bge") | name.contains("e5"), prefix).otherwise(""), text(c))


def model_query(c: Column | str, model: Column) -> Column:
    """A query with the prefix that its embedding model expects, by the model's name."""
    return _prefixed(c, model, D.QUERY_PREFIX)


def model_passage(c: Column | str, model: Column) -> Column:
    return _prefixed(c, model, D.PASSAGE_PREFIX)


def clamped(c: Column) -> Column:
    """Rounded half to even, within 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(c, 0).cast("int")))


def certifications(c: Column | str) -> Column:
    """array<string> from JSON that is null, a text, or a list of texts and objects with a name and a provider."""
    v = F.try_parse_json(text(c))
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull() & (F.schema_of_variant(v) != "VOID"), F.array(v)))
    get = lambda x, *names: F.coalesce(*[F.nullif(strip(F.try_variant_get(x, f"$.{n}", "string")), F.lit("")) for n in names])
    named = lambda x: F.concat(get(x, "name", "title"), F.coalesce(F.concat(F.lit(" ("), get(x, "provider", "issuer", "organization"), F.lit(")")), F.lit("")))
    out = F.transform(items, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), named(x)).otherwise(strip(F.try_variant_get(x, "$", "string"))))
    return F.coalesce(F.filter(out, lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"))
