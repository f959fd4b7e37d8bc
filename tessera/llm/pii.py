"""Personal data: rule matches, and terms that corpus co-occurrence shows to disclose them. DataFrame functions only.

Method (information-theoretic sanitisation): every found value is a protected entity, and the words close to it are its context.
All counts are of distinct texts of the corpus, so that copies change nothing: n of them, n_e hold the entity e, n_t the term t,
and in n_et t stands in a context of e. PMI(e; t) = log2(n * n_et / (n_e * n_t)) says how many bits t tells about e, out of the
IC(e) = log2(n / n_e) there are. A term that stands in at least `min_support` distinct contexts of e and tells at least
`disclosure` of IC(e) discloses it: each occurrence of the term in any text, beside an entity or not, is a span of kind `term`
with the largest share of any entity (within a base span it is part of that span).

sanitise() generalises a term to the narrowest class that no longer discloses its entity, by the same measure over classes: first
letter and length (`[K SHORT]`), then length alone (`[SHORT]`, `[WORD]`, `[LONG]`); if even that discloses it, the term is removed.

Defined cases: a null text counts as empty; repeated rows each give a row; a very long text is scanned whole; other columns are not
read; an empty table gives an empty result. Offsets count code points, the end is exclusive. The patterns are written with possessive loops and with starts
only where a run starts or the last match ended: they match what the plain forms do, in linear time and without recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, prefixed, read
from tessera.operators.matching import once

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # of fewer digits it can't be a card, and a run is taken whole or not at all: a table of numbers holds no match
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these holds no match.
_HINT = {"email": "@", "ip": ".", "phone": "+"}
_BYTE_PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
_TERM = r"\p{L}{3,}"
#: Code points on either side of an entity that hold its context, and words taken from them, unless told otherwise. They say what a
#: context is; terms are marked wherever they stand.
REACH, CONTEXT = 100, 5
#: Bytes up to which the disclosing terms, and those that each text holds, are broadcast, which is checked; beyond that they are
#: joined by an exchange.
TERM_BYTES = 32 << 20
#: Spans that are gathered in one array before another is begun, so that many take linear time.
_RUN = 512
#: Matches that are placed one after another.
_BLOCK = 32


_SPAN = "struct<kind:string,start:int,end:int,match:string>"
_CUT = "struct<from:int,start:int,put:string>"
_FOUND = "struct<start:int,end:int,share:double,put:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: part.rlike(_BYTE_PART))
    if kind == "card":
        digits = _digits(m)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _checker(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["match"])


def _positions(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, start, end, match>>: the pieces between the matches give the offsets. Matches are placed in blocks, each
    from the sum of the blocks before it, so that the work for many matches grows with their number."""
    step = f"struct<at:int,found:array<{_SPAN}>>"
    all_pairs = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap")), lambda p: p["m"].isNotNull())
    none = F.array().cast(f"array<{_SPAN}>")

    def put(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), p["m"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found")).cast(step)

    def placed(pairs: Column, at: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), none.alias("found")).cast(step), put, lambda acc: acc["found"])

    def in_blocks(pairs: Column) -> Column:
        block = lambda k: F.slice(pairs, k * _BLOCK + 1, F.lit(_BLOCK))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")), lambda k: F.aggregate(block(k), F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["m"])))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return once(begins, lambda at: F.flatten(F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda first, k: placed(block(k), first))))

    return once(all_pairs, lambda pairs: F.when(F.size(pairs) == 0, none).when(F.size(pairs) <= _BLOCK, placed(pairs, F.lit(0))).otherwise(in_blocks(pairs)))


def base_spans(text: Column) -> Column:
    """All rule matches of a text (not null), by kind in the order of KINDS, then start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    found = []
    for kind in KINDS:
        near = text.contains(_HINT[kind]) if kind in _HINT else F.lit(True)
        if kind in ("ip", "card"):
            near = near & text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else PATTERNS[kind])
        spans = F.filter(_positions(text, PATTERNS[kind], kind), _checker(kind))
        found.append(F.when(near, spans).otherwise(none))
    return F.concat(*found)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key, key2): rows are told apart by id and text together, as an id may be null or stand twice."""
    slim = prefixed(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return slim.withColumns({"key": F.xxhash64("doc_id", "text"), "key2": F.hash("doc_id", "text")})


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _keyed(docs, id_col, text_col).withColumn("base", base_spans(F.col("text")))


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["match"])).when(s["kind"] == "ip", s["match"]).otherwise(_digits(s["match"])))


def _contexts(reach: int, words: int) -> Column:
    """array<struct<entity, terms>> of the spans in base: up to so many words on either side, within so many code points."""

    def one(s: Column) -> Column:
        low = F.greatest(F.lit(0), s["start"] - reach)
        left = _positions(F.substring("text", low + 1, s["start"] - low), _TERM, "term")
        right = _positions(F.substring("text", s["end"] + 1, F.lit(reach)), _TERM, "term")
        # a word that the edge of the piece may cut is left out
        left = F.slice(F.reverse(F.filter(left, lambda w: (w["start"] > 0) | (low == 0))), 1, words)
        right = F.slice(F.filter(right, lambda w: w["end"] < reach), 1, words)
        return F.struct(_entity(s).alias("entity"), F.transform(F.concat(left, right), lambda w: F.lower(w["match"])).alias("terms"))

    return F.transform("base", one)


def _spans(keyed: DataFrame, reach: int, words: int) -> DataFrame:
    """(key, key2, copy, copy2, base, contexts) of every row: the one place where patterns are searched. copy names the text."""
    told = keyed.withColumn("base", base_spans(F.col("text"))).select("key", "key2", F.xxhash64("text").alias("copy"), F.hash("text").alias("copy2"), "base", "text")
    none = F.array().cast("array<struct<entity:string,terms:array<string>>>")
    return checkpointed(told.select("key", "key2", "copy", "copy2", "base", F.when(F.size("base") > 0, _contexts(reach, words)).otherwise(none).alias("contexts")))


def _shares(pairs: DataFrame, entities: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(entity, term, share) from n_et, n_e and n_t."""
    ic = F.log2(n / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
    return pairs.join(entities, "entity").join(terms, "term").where(ic > 0).select("entity", "term", (pmi / ic).alias("share"))


def _counted(keyed: DataFrame, spans: DataFrame, as_term: Callable[[Column], Column], min_support: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(entity, term, n_et), (entity, n_e), (term, n_t) of the terms that entities have beside them, and n; as_term names the term
    that a lower-case or other word stands for."""
    n = spans.select("copy", "copy2").distinct().count()
    met = spans.where(F.size("contexts") > 0).select("copy", "copy2", F.explode("contexts").alias("c")).select("copy", "copy2", "c.entity", F.transform("c.terms", as_term).alias("terms"))
    met = checkpointed(met.distinct())
    entities = met.select("entity", "copy", "copy2").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    told = met.select("entity", "copy", "copy2", F.xxhash64("terms").alias("context"), F.explode(F.array_distinct("terms")).alias("term"))
    support = told.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    pairs = told.select("entity", "term", "copy", "copy2").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    pairs = checkpointed(pairs.join(support.drop("n"), ["entity", "term"]))
    # only the terms that may disclose something reach an exchange
    wanted = _sent(checkpointed(pairs.select("term").distinct()), F.octet_length("term") + 8)
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), as_term))
    hits = keyed.select(F.xxhash64("text").alias("copy"), F.hash("text").alias("copy2"), F.explode(words).alias("term")).join(wanted, "term", "left_semi")
    return pairs, entities, hits.distinct().groupBy("term").agg(F.count("*").alias("n_t")), n


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = 3, disclosure: float = 0.8, reach: int = REACH, context: int = CONTEXT) -> DataFrame:
    """(entity, term, share): terms that tell at least that share of IC(entity), from counts over all distinct texts of the corpus."""
    keyed = _keyed(docs, id_col, text_col)
    return _disclosing(keyed, _spans(keyed, reach, context), min_support, disclosure)


def _disclosing(keyed: DataFrame, spans: DataFrame, min_support: int, disclosure: float) -> DataFrame:
    return checkpointed(_shares(*_counted(keyed, spans, F.lower, min_support)).where(F.col("share") >= disclosure))


def _marked(keyed: DataFrame, spans: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text, base, terms): terms (term, ...) where they stand, each with the columns that terms has."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.lower))
    met = keyed.select("key", "key2", F.explode(words).alias("term")).join(_sent(terms, F.octet_length("term") + 40), "term")
    told = checkpointed(met.groupBy("key", "key2").agg(F.collect_set(F.struct(*terms.columns)).alias("told")))
    told = _sent(told, F.aggregate("told", F.lit(12), lambda n, t: n + F.octet_length(t["term"]) + 40))
    based = spans.where(F.size("base") > 0).select("key", "key2", "base").dropDuplicates(["key", "key2"])
    based = _sent(based, F.aggregate("base", F.lit(12), lambda n, s: n + F.octet_length(s["match"]) + 24))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = keyed.join(based, ["key", "key2"], "left").withColumn("base", F.coalesce("base", none(_SPAN))).join(told, ["key", "key2"], "left")
    return rows.withColumn("terms", F.when(F.col("told").isNull(), none(_FOUND)).otherwise(_occurrences())).drop("told")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = 3, disclosure: float = 0.8, reach: int = REACH, context: int = CONTEXT) -> DataFrame:
    """(doc_id, text, base, terms) of every row: base array<struct<kind, start, end, match>>, terms array<struct<start, end, share,
    put>>, where put is null."""
    keyed = _keyed(docs, id_col, text_col)
    spans = _spans(keyed, reach, context)
    terms = _disclosing(keyed, spans, min_support, disclosure).groupBy("term").agg(F.max("share").alias("share"))
    return _marked(keyed, spans, checkpointed(terms.withColumn("put", F.lit(None).cast("string"))))


def _sent(df: DataFrame, size: Column) -> DataFrame:
    """df, marked to be broadcast if its rows have at most TERM_BYTES together."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= TERM_BYTES else df


def _occurrences() -> Column:
    """array<struct<start, end, share, put>>: every place in text of the terms in told, in order, but those within a base span."""
    spans = f"array<{_FOUND}>"
    step = f"struct<at:int,run:{spans},done:array<{spans}>>"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)).alias("m"), F.split("text", _TERM, -1).alias("gap"))

    def put(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["m"]), F.lit(0))
        own = F.filter("told", lambda t: t["term"] == F.lower(p["m"]))
        new = F.transform(F.filter(own, lambda t: ~F.exists("base", lambda s: (s["start"] <= start) & (s["end"] >= end))), lambda t: F.struct(start.alias("start"), end.alias("end"), t["share"].alias("share"), t["put"].alias("put")))
        full = F.size(acc["run"]) >= _RUN
        run = F.when(F.size(own) == 0, acc["run"]).when(full, new).otherwise(F.concat(acc["run"], new))
        done = F.when((F.size(own) > 0) & full, F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"])
        return F.struct(end.alias("at"), run.alias("run"), done.alias("done")).cast(step)

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("run"), F.array().cast(f"array<{spans}>").alias("done")).cast(step)
    return F.aggregate(pairs, empty, put, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["run"]))))


def _length(word: Column) -> Column:
    return F.when(F.length(word) <= 5, "SHORT").when(F.length(word) <= 9, "WORD").otherwise("LONG")


#: Classes of a word, from narrow to wide: first letter and length, then length alone.
_CLASSES: list[Callable[[Column], Column]] = [lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit(" "), _length(w)), _length]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = 3, disclosure: float = 0.8, reach: int = REACH, context: int = CONTEXT) -> DataFrame:
    """(doc_id, text): base spans become their kind in brackets; disclosing terms become the narrowest class in brackets that does
    not disclose their entities, or go."""
    keyed = _keyed(docs, id_col, text_col)
    spans = _spans(keyed, reach, context)
    terms = _disclosing(keyed, spans, min_support, disclosure)
    for level, named in enumerate(_CLASSES):
        wide = _shares(*_counted(keyed, spans, named, 1)).select("entity", F.col("term").alias("class"), F.col("share").alias(f"share{level}"))
        terms = terms.withColumn("class", named(F.col("term"))).join(wide, ["entity", "class"], "left").withColumnRenamed("class", f"class{level}")
    safe = lambda level: F.coalesce(F.col(f"share{level}"), F.lit(0.0)) < disclosure
    depth = F.when(safe(0), 0).when(safe(1), 1).otherwise(2)  # the widest that any entity asks for
    terms = terms.groupBy("term").agg(F.max("share").alias("share"), F.max(depth).alias("depth"))
    put = F.when(F.col("depth") == 2, F.lit("")).otherwise(F.concat(F.lit("["), F.when(F.col("depth") == 0, _CLASSES[0](F.col("term"))).otherwise(_CLASSES[1](F.col("term"))), F.lit("]")))
    found = _marked(keyed, spans, checkpointed(terms.select("term", "share", put.alias("put"))))
    cuts = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["put"].alias("put"))),
    )
    # cuts are disjoint or nested after this; pieces between them are taken by position, without a fold over the text
    step = f"struct<at:int,done:array<array<{_CUT}>>,run:array<{_CUT}>>"

    def merge(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], acc["at"])
        new = F.array(F.struct(acc["at"].alias("from"), begin.alias("start"), F.when(s["start"] < acc["at"], F.lit("")).otherwise(s["put"]).alias("put")))
        full = F.size(acc["run"]) >= _RUN
        told = F.struct(s["end"].alias("at"), F.when(full, F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"]).alias("done"), F.when(full, new).otherwise(F.concat(acc["run"], new)).alias("run")).cast(step)
        return F.when(s["end"] <= acc["at"], acc).otherwise(told)

    def joined(acc: Column) -> Column:
        cut = F.flatten(F.concat(acc["done"], F.array(acc["run"])))
        pieces = F.transform(cut, lambda c: F.concat(F.substring("text", c["from"] + 1, c["start"] - c["from"]), c["put"]))
        return F.concat(F.array_join(pieces, ""), F.substring("text", acc["at"] + 1, F.length("text")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_CUT}>>").alias("done"), F.array().cast(f"array<{_CUT}>").alias("run")).cast(step)
    return found.select("doc_id", F.aggregate(F.array_sort(cuts), start, merge, joined).alias("text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    found = scan(read(spark, sf_dir, "documents"))
    said = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", lambda s: said(s["kind"], s))
    terms = F.transform(F.array_distinct(F.transform("terms", lambda s: F.struct(s["start"], s["end"]))), lambda s: said(F.lit("term"), s))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))
