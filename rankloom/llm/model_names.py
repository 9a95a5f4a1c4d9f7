"""What the written names of models say: organisation, family, version, size, tuning, repacking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.linkage import Rule, match
from rankloom.sources.shared import joined, stored

SIZE = r"(?<![\d.])(?:\d+ ?x ?)?\d+(?:\.\d+)? ?(?:billion|b)(?![a-z])(?:[- ]*a\d+ ?b(?![a-z]))?"
VERSION = r"(\d+)(?:[.p-](\d+))?"
#: Words of three letters or more of any script go before shorter ones, and those before bare numbers.
FAMILY, SHORT = r"\p{L}{3,}", r"\p{L}+"


@dataclass(frozen=True)
class Words:
    """What in a name is no part of the family. The fixed values are words in general use for models; give others for other fields."""

    tunings: dict[str, list[str]] = field(
        default_factory=lambda: {
            "base": ["base", "pretrained"], "chat": ["chat"], "coder": ["code", "coder"], "distill": ["distill", "distilled"],
            "instruct": ["instruct", "inst", "it"], "thinking": ["thinking", "reasoning"], "vision": ["vision", "vl"],
        }
    )
    org_endings: tuple[str, ...] = ("ai", "labs")
    copies: str = "gguf|awq|gptq|nvfp4|fp8|bnb[-_ ]?4bit|mlx|int4|int8"

    @property
    def tuning(self) -> str:
        return r"(?<![a-z])(" + "|".join(sorted((w for v in self.tunings.values() for w in v), key=len, reverse=True)) + r")(?![a-z])"


@dataclass(frozen=True)
class Weights:
    """How much each rule of the linkage weighs, and the truths that stand for partial agreement."""

    whole: float = 4.0
    partly: float = 1.6
    pointed: float = 2.0
    same_window: float = 1.7
    other_window: float = 0.7
    contradiction: float = 12.0  # more than all that can pull
    doubt: float = 1.5
    near_family: float = 0.8
    one_of_several: float = 0.6
    unsaid: float = 0.45


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(text: Column, words: Words = Words()) -> Column:
    """struct(family, version, size, tuning, copy), '' where the text does not say. A name without letters has the family '#'."""
    kinds = F.create_map(*[F.lit(x) for k, v in words.tunings.items() for w in v for x in (w, k)])

    def rest(s: Column, copy: Column, size: Column, tuning: Column) -> Column:
        minor = F.regexp_extract(s, VERSION, 2)
        version = F.concat(F.regexp_extract(s, VERSION, 1), F.when(minor != "", F.concat(F.lit("."), minor)).otherwise(""))
        found = [F.nullif(F.regexp_extract(s, p, 0), F.lit("")) for p in (FAMILY, SHORT)]
        family = F.coalesce(*found, F.when(s.rlike(r"\d"), "#"), F.lit(""))
        return F.struct(family.alias("family"), version.alias("version"), size.alias("size"), tuning.alias("tuning"), copy.alias("copy"))

    def tuned(s: Column, copy: Column, size: Column) -> Column:
        tuning = F.coalesce(F.try_element_at(kinds, F.regexp_extract(s, words.tuning, 1)), F.lit(""))
        return _let(F.struct(F.regexp_replace(s, words.tuning, " ").alias("s"), tuning.alias("t")), lambda x: rest(x["s"], copy, size, x["t"]))

    def sized(s: Column, copy: Column) -> Column:
        size = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, SIZE, 0), "billion", "b"), r"[- ]", "")
        return _let(F.struct(F.regexp_replace(s, SIZE, " ").alias("s"), size.alias("z")), lambda x: tuned(x["s"], copy, x["z"]))

    def copied(s: Column) -> Column:
        copy = F.regexp_replace(F.regexp_extract(s, f"({words.copies})", 1), r"[-_ ]", "")
        return _let(F.struct(F.regexp_replace(s, f"[-_ ]?({words.copies})", " ").alias("s"), copy.alias("c")), lambda x: sized(x["s"], x["c"]))

    return _let(F.regexp_replace(F.lower(F.btrim(F.coalesce(text, F.lit("")))), r"\s+", " "), copied)


def org_part(identifier: Column) -> Column:
    return F.when(identifier.contains("/"), F.regexp_replace(F.lower(F.substring_index(identifier, "/", 1)), r"[^\p{L}\p{N}]", ""))


def name_part(identifier: Column) -> Column:
    """Behind the organisation, without a variant like ':free' or '@0612'."""
    return F.regexp_replace(F.substring_index(identifier, "/", -1), "[:@].*$", "")


def org_forms(orgs: DataFrame, words: Words = Words()) -> DataFrame:
    """form, org: every way to write a listed organisation: with an ending, or its first letter and a tail of two letters or more."""
    listed = orgs.where("org is not null").select(F.lower("org").alias("org"), F.regexp_replace(F.lower("org"), r"[^\p{L}\p{N}]", "").alias("o"))
    o = F.col("o")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(o) - 1)), lambda i: F.concat(F.substring(o, 1, 1), F.right(o, i)))
    forms = F.array_union(F.array(o, *[F.concat(o, F.lit(e)) for e in words.org_endings]), tails)
    every = listed.select("org", "o", F.explode(forms).alias("form"))
    rank = F.when(F.col("form").startswith(F.col("o")), 0).otherwise(1)  # a full name goes before another's abbreviation
    return every.groupBy("form").agg(F.min_by("org", F.struct(rank, "org")).alias("org"))


def with_org(df: DataFrame, forms: DataFrame, out: str) -> DataFrame:
    """out: the listed organisation of the form in `out`, or the form itself."""
    f = forms.select(F.col("form").alias("_form"), F.col("org").alias("_org"))
    return joined(df, f, F.col(out) == F.col("_form"), "left").withColumn(out, F.coalesce("_org", out)).drop("_form", "_org")


def _key(*names: str) -> Column:
    """One value for each combination: a digest, as the written names are long."""
    return F.unhex(F.md5(F.to_json(F.array(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]))))


def _near(word: Column) -> Column:
    """The word, and the word less each of its letters: words one edit apart share one of these."""
    n = F.length(word)
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substr(word, i + 1)))))


def _one_edit(a: Column, b: Column) -> Column:
    """At most one letter added, dropped, replaced, or exchanged with the next."""
    swap = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.size(swap) > 0))


def hub_entities(hub: DataFrame, forms: DataFrame, words: Words = Words()) -> DataFrame:
    """rec, h (the model's key), org, family, version, size, tuning, copy, ctx of every record with a family."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    ctx = F.try_element_at(F.filter(tags, lambda t: t.startswith("ctx:")), F.lit(1))
    base = F.exists(tags, lambda t: t.startswith("base_model:"))
    p = hub.select(F.col("rec_id").alias("rec"), org_part(F.col("hf_id")).alias("org"), parts(name_part(F.col("hf_id")), words).alias("p"), F.try_element_at(F.split(ctx, ":"), F.lit(2)).try_cast("bigint").alias("ctx"), base.alias("base"))
    copy = F.when((F.col("p.copy") == "") & F.col("base"), "copy").otherwise(F.col("p.copy"))
    e = with_org(p.select("rec", "org", "p.family", "p.version", "p.size", "p.tuning", copy.alias("copy"), "ctx"), forms, "org")
    return e.where("rec is not null and org is not null and family <> ''").withColumn("h", _key("org", "family", "version", "size", "tuning", "copy"))


def usage_profiles(usage: DataFrame, forms: DataFrame, words: Words = Words()) -> DataFrame:
    """rec, u (key of all that is said), core (key of its id without variant) and what id, name and hf_id say."""
    a, b, c = parts(name_part(F.col("or_id")), words), parts(F.try_element_at(F.split("name", ":"), F.lit(-1)), words), parts(name_part(F.nullif("hf_id", F.lit(""))), words)
    p = usage.select(
        F.col("rec_id").alias("rec"), F.coalesce(org_part(F.col("or_id")), org_part(F.col("hf_id"))).alias("org"), org_part(F.col("hf_id")).alias("link_org"),
        F.lower(F.regexp_replace(name_part(F.col("or_id")), r"[^\p{L}\p{N}.]+", "-")).alias("core"), a.alias("a"), b.alias("b"), c.alias("c"), F.col("context_length").alias("ctx"),
    )
    names = ("family", "version", "size", "tuning", "copy")
    both = [F.array_sort(F.array_distinct(F.filter(F.array(f"a.{x}", f"b.{x}"), lambda v: v != ""))).alias(x) for x in names]
    p = p.select("rec", "org", "link_org", "core", *both, *[F.col(f"c.{x}").alias(f"link_{x}") for x in names], "ctx")
    named = F.filter("family", lambda f: f != "#")  # a text of bare numbers beside one with a name says nothing of the family
    p = p.withColumn("family", F.when(F.size(named) > 0, named).otherwise(F.col("family")))
    p = with_org(with_org(p, forms, "org"), forms, "link_org").where("rec is not null and org is not null and size(family) > 0")
    lists = {f"_{x}": F.concat_ws(",", x) for x in names}
    return p.withColumns(lists).withColumn("u", _key("org", "core", *lists, "link_org", *[f"link_{x}" for x in names], "ctx")).withColumn("core", _key("org", "core")).drop(*lists)


def _says(x: str, w: Weights) -> Column:
    """How well what a usage record says of x (a list) agrees with the hub's value: a missing one is doubtful, another one wrong."""
    said, is_ = F.col(x), F.col(f"h_{x}")
    return (
        F.when((F.size(said) == 0) & (is_ == ""), 1.0)
        .when(F.size(said) == 0, w.unsaid)
        .when(is_ == "", 0.0)
        .when((F.size(said) == 1) & (F.get(said, 0) == is_), 1.0)
        .when(F.array_contains(said, is_), w.one_of_several)
        .otherwise(0.0)
    )


def candidates(h: DataFrame, u: DataFrame, near_family: float) -> DataFrame:
    """u with each h (h_... columns) of its organisation, of a family of its up to one edit, and of its version and size, where it says any.

    Families one edit apart are found by equal words less one letter; families of fewer than three
    letters only match themselves. What a usage record says of version and size goes into the key
    of the join, so that no pairs of other versions or sizes arise; hub models stand in the table once
    for each choice of what may be unsaid.
    """
    said = ["version", "size", "tuning", "copy"]
    words_h = h.select("org", "family").distinct().select("org", F.col("family").alias("hf"), F.explode(_near(F.col("family"))).alias("w"))
    words_u = u.select("org", F.explode("family").alias("uf")).distinct().select("org", "uf", F.explode(_near(F.col("uf"))).alias("w"))
    long = (F.length("uf") >= 3) & (F.length("hf") >= 3) & _one_edit(F.col("uf"), F.col("hf"))
    near = words_u.join(words_h, ["org", "w"]).where((F.col("uf") == F.col("hf")) | long).select("org", "uf", "hf", F.when(F.col("uf") == F.col("hf"), 1.0).otherwise(near_family).alias("alike")).distinct()
    shown = lambda v, s: F.struct(v.alias("v"), s.alias("s"))
    kinds = F.array(*[shown(F.col("version") if v else F.lit(None).cast("string"), F.col("size") if s else F.lit(None).cast("string")) for v in (0, 1) for s in (0, 1)])
    kinds = F.filter(kinds, lambda k: ~k["v"].eqNullSafe(F.lit("")) & ~k["s"].eqNullSafe(F.lit("")))  # nobody says that there is none
    hh = h.select("h", F.col("org").alias("o"), *[F.col(x).alias(f"h_{x}") for x in ("family", *said)], "ctxs", F.explode(kinds).alias("key"))
    some = lambda x: F.when(F.size(x) > 0, F.col(x)).otherwise(F.array(F.lit(None).cast("string")))
    uu = u.withColumn("uf", F.explode("family")).withColumn("_v", F.explode(some("version"))).withColumn("_s", F.explode(some("size"))).withColumn("key", shown(F.col("_v"), F.col("_s"))).drop("_v", "_s")
    key = lambda *c: F.xxhash64(*[x for n in c for x in (F.col(n), F.col(n).isNull())])
    left = uu.join(near, ["org", "uf"]).withColumn("_key", key("org", "hf", "key.v", "key.s"))
    right = hh.withColumn("_key", key("o", "h_family", "key.v", "key.s")).withColumnRenamed("key", "hkey")
    exact = (F.col("org") == F.col("o")) & (F.col("hf") == F.col("h_family")) & F.col("key").eqNullSafe(F.col("hkey"))
    return left.join(right, "_key").where(exact).drop("_key", "key", "hkey")


def linked_models(hub: DataFrame, usage: DataFrame, orgs: DataFrame, *, words: Words = Words(), weights: Weights = Weights(), least_confidence: float = 0.501) -> DataFrame:
    """Pairs of hub and usage records of one model: rec_a, rec_b (rec_a < rec_b), confidence and converged.

    Records that say the same are one entity while matching, so that repeated rows cost nothing;
    their pairs are formed at the end. Candidates: see `candidates`. Another tuning or repacking is a
    rule that weighs more than all that can pull. Two models that fit a record equally well come out at
    one half each, which is no match.

    Records with null ids, or without an organisation, a letter or a digit in their names, match
    nothing. Empty tables give an empty result.
    """
    w, said = weights, ["version", "size", "tuning", "copy"]
    forms = stored(org_forms(orgs, words))
    hubs, users = stored(hub_entities(hub, forms, words)), stored(usage_profiles(usage, forms, words))
    h = hubs.groupBy("h", "org", "family", "version", "size", "tuning", "copy").agg(F.array_sort(F.collect_set("ctx")).alias("ctxs"))  # the distinct window sizes of one model
    u = users.drop("rec").dropDuplicates(["u"])
    agreement = {x: _says(x, w) for x in said}
    least = F.least(*agreement.values())
    part = F.greatest(F.lit(0.0), F.col("alike") + sum(agreement.values(), F.lit(0.0)) - len(said))
    pointed = (F.col("link_org") == F.col("o")) & (F.col("link_family") == F.col("h_family"))
    for x in said:
        pointed = pointed & (F.col(f"link_{x}") == F.col(f"h_{x}"))
    windows = F.array_contains("ctxs", F.col("ctx"))
    rules = [
        Rule(F.when((least == 1) & (F.col("alike") == 1), 1.0), w.whole),
        Rule(F.when((least == 1) & (F.col("alike") < 1), F.col("alike")), w.whole * w.near_family),  # else it would cost the same to follow the near family as the very one
        Rule(F.when(least < 1, part), w.partly),
        Rule(F.when(pointed, F.col("alike")), w.pointed),
        Rule(F.when(windows, F.col("alike")), w.same_window),
        Rule(F.when(~windows & (F.size("ctxs") > 0), 1.0), w.other_window, pulls=False),
        Rule(F.when(least == 0, 1.0), w.contradiction, pulls=False),
        Rule(F.lit(1.0), w.doubt, pulls=False),
    ]
    found = match(candidates(h, u, w.near_family), "u", "h", "core", rules).where(F.col("confidence") > least_confidence)
    pairs = found.join(users.select("u", F.col("rec").alias("b")), "u").join(hubs.select("h", F.col("rec").alias("a")), "h")
    best = F.max_by(F.struct("confidence", "converged"), "confidence").alias("x")
    return pairs.groupBy(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b")).agg(best).select("rec_a", "rec_b", "x.confidence", "x.converged")
