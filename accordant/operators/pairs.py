"""Duplicate candidates inside an organization and kind.

Copies are never paired with one another. Entities with the same title key, cities, years and batch
form one content; contents with the same title, years and batch form one hub. Contents and hubs are
linked as stars, and only different contents are compared, found through shared rare characters and
a shared city or year. Every pair the rule proposes can be read off the result: two members of one
content or hub, of two linked hubs, or of two linked contents; two members that carry different
posting ids are separate, all others are for review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.similarity import indel_ratio, jaccard_sets
from accordant.functions.text import clean_set, clean_text, let, title_key
from accordant.rules import PairRules
from accordant.session import fact_join, stored

BLOCK = ["org_id", "kind"]
OCCURRENCES = 1 << 20  # a token is a code point times this, plus how often it came before


def contents(entities: DataFrame) -> DataFrame:
    """Entities with their comparable content and its id.

    entities: entity_id, org_id, kind, title, cities, graduation_years, recruitment_type,
    official_job_id, identity_hint, is_new_weak.
    """
    keyed = entities.select(
        "entity_id", *BLOCK, "official_job_id", "identity_hint", "is_new_weak",
        title_key(F.col("title")).alias("title_key"),
        clean_set(F.col("cities"), lower=True).alias("cities"),
        clean_set(F.col("graduation_years"), lower=True).alias("years"),
        F.lower(clean_text(F.col("recruitment_type"))).alias("batch"),
    )
    content = F.sha2(
        F.to_json(F.struct(F.col("org_id").cast("string").alias("o"), "kind", "title_key", "cities", "years", "batch")),
        256,
    )
    return keyed.withColumn("content_id", F.substring(content, 1, 32))


def content_groups(members: DataFrame) -> DataFrame:
    """One line per content: its representative, size, and what ids its members carry."""
    return members.groupBy("content_id", *BLOCK, "title_key", "cities", "years", "batch").agg(
        F.min("entity_id").alias("entity_id"),
        F.count("*").alias("members"),
        F.max("is_new_weak").alias("has_new"),
        F.min("official_job_id").alias("min_id"),
        F.max("official_job_id").alias("max_id"),
        F.count("official_job_id").alias("with_id"),
    )


def star_pairs(members: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """Pairs inside a content, as a star over ids and a star inside each id.

    Members of one id point at the first of them; the first members of the ids point at the first
    member without an id, else at the first of all. Two members are separate exactly if both carry
    an id and the ids differ; anything else in a content is for review.
    """
    job = F.coalesce("official_job_id", F.lit(""))
    base = members.withColumn("job", job)
    by_id = base.groupBy("content_id", "job").agg(F.min("entity_id").alias("lead"), F.max("is_new_weak").alias("new_in_id"))
    # '' sorts first, so a member without an id becomes the centre where there is one.
    centre = by_id.groupBy("content_id").agg(
        F.min(F.struct("job", "lead")).alias("c"), F.max("new_in_id").alias("new_in_content")
    )
    leads = fact_join(by_id, centre, ["content_id"], "inner").withColumn("centre", F.col("c.lead"))
    linked = fact_join(base, leads, ["content_id", "job"], "inner").filter("new_in_content")
    is_lead = F.col("entity_id") == F.col("lead")
    other = F.when(is_lead, F.col("centre")).otherwise(F.col("lead"))
    clash = is_lead & (F.col("job") != "") & (F.col("c.job") != "") & (F.col("job") != F.col("c.job"))
    batch_equal = F.col("batch") != ""
    score = rules.title + rules.city + rules.year + F.when(batch_equal, F.lit(rules.batch)).otherwise(0.0)
    hinted = F.col("identity_hint").isNotNull()
    return linked.filter(other != F.col("entity_id")).select(
        *BLOCK,
        F.least("entity_id", other).alias("left_id"),
        F.greatest("entity_id", other).alias("right_id"),
        F.lit(1.0).alias("title_similarity"),
        F.lit(1.0).alias("city_similarity"),
        F.lit(1.0).alias("year_similarity"),
        batch_equal.alias("batch_equal"),
        F.when(clash, F.lit(0.0))
        .when(hinted, F.greatest(score, F.lit(rules.hint_score)))
        .otherwise(score)
        .alias("score"),
        F.when(clash, "SEPARATE").otherwise("REVIEW").alias("decision"),
    )


def title_floor(rules: PairRules, batch_equal: bool) -> float:
    """The least title similarity a kept pair can have."""
    rest = rules.city + rules.year + (rules.batch if batch_equal else 0.0)
    return min((rules.keep_score - rest) / rules.title, rules.conflict_title)


def title_tokens(title: Column) -> Column:
    """Characters as numbers made distinct by their occurrence: shared tokens = shared characters."""
    chars = F.filter(F.split(title, ""), lambda c: c != "")
    return F.transform(
        chars,
        lambda c, i: F.ascii(c).cast("long") * OCCURRENCES + F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)),
    )


def title_keys(prefix: Column, size: Column, single: Column) -> Column:
    """Pairs (first, second, place of the second) among the first `prefix` tokens, in token order.

    A title that may share a single token with its partner (`single`) lists its tokens alone too.
    """
    tokens = F.col("tokens")
    places = F.when(F.least(prefix, size) >= 1, F.sequence(F.lit(1), F.least(prefix, size))).otherwise(F.array().cast("array<int>"))

    def key(first: Column, second: Column, place: Column) -> Column:
        return F.struct(first.alias("first"), second.alias("second"), place.cast("int").alias("place"))

    pairs = F.flatten(
        F.transform(
            places,
            lambda j: F.transform(F.slice(tokens, F.lit(1), j - 1), lambda first: key(first, F.element_at(tokens, j), j)),
        )
    )
    alone = F.transform(F.slice(tokens, 1, 2), lambda t, i: key(t, F.lit(0).cast("long"), i + 1))
    return F.concat(pairs, F.when(single, alone).otherwise(F.array().cast("array<struct<first:bigint,second:bigint,place:int>>")))


def title_scopes(groups: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """BLOCK, title_key, token, in_batch, floor, fresh: where a title may meet others, and the least similarity there."""
    apart, inside = title_floor(rules, False), title_floor(rules, True)
    if min(apart, inside) <= 0.5:
        raise ValueError("the rules must ask for a title similarity above one half")

    def scope(tokens: Column, in_batch: bool) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(in_batch).alias("in_batch")))

    batch = F.transform(city_tokens(), lambda c: F.concat(F.lit("b:"), F.col("batch"), F.lit(":"), c))
    in_batch = F.when(F.col("batch") != "", F.concat(batch, year_tokens())).otherwise(F.array().cast("array<string>"))
    return (
        groups.filter("title_key <> ''")
        .select(*BLOCK, "title_key", "has_new", F.inline(F.concat(scope(city_tokens(), False), scope(in_batch, True))))
        .groupBy(*BLOCK, "title_key", "token", "in_batch")
        .agg(F.max("has_new").alias("fresh"))
        .withColumn("floor", F.when(F.col("in_batch"), inside - 1e-9).otherwise(apart - 1e-9))
    )


def ordered_titles(groups: DataFrame) -> DataFrame:
    """BLOCK, title_key, tokens: the tokens of each title from the rarest in its block to the most common."""
    titles = groups.filter("title_key <> ''").select(*BLOCK, "title_key").distinct()
    spread = titles.select(*BLOCK, "title_key", F.explode(title_tokens(F.col("title_key"))).alias("code"))
    # One line per block and token.
    frequency = spread.groupBy(*BLOCK, "code").agg(F.count("*").alias("df"))
    return fact_join(spread, frequency, [*BLOCK, "code"], "inner").groupBy(*BLOCK, "title_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "code"))), lambda x: x["code"]).alias("tokens")
    )


def title_pairs_met(groups: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """Pairs of different titles that share enough characters for a kept pair: BLOCK, left_title, right_title, floor.

    A pair of different contents qualifies only with a shared city, or a shared year within one batch, so titles
    meet within a city, and at a lower floor within a city or year of one batch. There, with s <= t characters,
    a common subsequence of the floor f needs ceil(f (s + t) / 2) shared tokens. That is f s of the shorter title and
    f / (2 - f) t of the longer one at least, so the first two shared tokens, rarest first, are among the
    first s - ceil(f s) + 2 of the shorter title, which is indexed, and the first t - ceil(f / (2 - f) t) + 2 of the
    longer one, which probes. Both list pairs of these tokens; a pair of titles is taken under its first two shared
    tokens only. Lengths, places and the number of shared tokens are tested at once. Titles of one and two characters
    may share a single token, which they list alone.
    """
    listed = fact_join(title_scopes(groups, rules), ordered_titles(groups), [*BLOCK, "title_key"], "inner")
    # A title becomes many keys below, so titles are dealt out before that.
    partitions = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = stored(listed.withColumn("size", F.size("tokens")).repartition(partitions), "titles")
    size, floor = F.col("size"), F.col("floor")
    ratio = floor / (2 - floor)

    def side(name: str, kept: Column, single: Column, *carried: str) -> DataFrame:
        prefix = (size - F.ceil(kept * size) + 2).cast("int")
        return listed.select(
            *BLOCK, "token", "in_batch", F.inline(title_keys(prefix, size, single)),
            *[F.col(c).alias(f"{name}_{c}") for c in ("title_key", "fresh", "size", "tokens", *carried)],
        ).withColumnsRenamed({"place": f"{name}_place", f"{name}_floor": "floor"})

    # The key rows are far more than the stored titles let a planner guess, so no side is broadcast.
    shorter, longer = side("x", floor, size == 1, "floor").hint("merge"), side("y", ratio, size <= 2)
    s, t = F.col("x_size"), F.col("y_size")
    needed = floor * (s + t) / 2
    enough = let(
        F.array_intersect("x_tokens", "y_tokens"),
        lambda c: (F.size(c) >= needed) & (F.get(c, F.lit(0)) == F.col("first")) & (F.coalesce(F.get(c, F.lit(1)), F.lit(0)) == F.col("second")),
    )
    # Beyond the second shared token there are no more than the rest of the shorter rest.
    left = F.when(F.col("second") == 0, 1).otherwise(2) + F.least(s - F.col("x_place"), t - F.col("y_place"))
    met = (
        shorter.join(longer, [*BLOCK, "token", "in_batch", "first", "second"])
        .filter((s < t) | ((s == t) & (F.col("x_title_key") < F.col("y_title_key"))))
        .filter((s >= ratio * t) & (left >= needed) & (F.col("x_fresh") | F.col("y_fresh")))
        .filter(enough)
    )
    names = F.least("x_title_key", "y_title_key"), F.greatest("x_title_key", "y_title_key")
    return met.groupBy(*BLOCK, names[0].alias("left_title"), names[1].alias("right_title")).agg(F.min("floor").alias("floor"))


def similar_titles(groups: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """Pairs of different titles that can reach the floor of a kept pair, with their similarity."""
    met = title_pairs_met(groups, rules)
    scored = met.withColumn("title_similarity", indel_ratio(F.col("left_title"), F.col("right_title")))
    return scored.filter("title_similarity >= floor").drop("floor")


def city_tokens(of: str = "") -> Column:
    cities = F.col(f"{of}cities")
    listed = F.when(F.size(cities) > 0, cities).otherwise(F.array(F.lit("")))
    return F.transform(listed, lambda x: F.concat(F.lit("c:"), x))


def year_tokens(of: str = "") -> Column:
    """Batch and year together; none without a batch."""
    years, batch = F.col(f"{of}years"), F.col(f"{of}batch")
    listed = F.when(F.size(years) > 0, years).otherwise(F.array(F.lit("")))
    marked = F.transform(listed, lambda x: F.concat(F.lit("y:"), batch, F.lit(":"), x))
    return F.when(batch != "", marked).otherwise(F.array().cast("array<string>"))


def represented(groups: DataFrame) -> DataFrame:
    """Contents as one end of a pair: BLOCK, title_key, years, batch, and `end` with all that scoring reads."""
    # Two contents are known to conflict only if each carries one id throughout.
    job = F.when((F.col("with_id") == F.col("members")) & (F.col("min_id") == F.col("max_id")), F.col("min_id"))
    end = F.struct("content_id", F.col("entity_id").alias("id"), "cities", "years", "batch", job.alias("job_id"), F.col("has_new").alias("fresh"))
    return groups.select(*BLOCK, "title_key", "years", "batch", end.alias("end"))


def hubs_of(contents: DataFrame) -> DataFrame:
    """The first content of each title, years and batch; fresh if any of them is."""
    first = F.min(F.struct("end.content_id", "end")).alias("m")
    found = contents.filter("batch <> ''").groupBy(*BLOCK, "title_key", "years", "batch").agg(first, F.max("end.fresh").alias("fresh"))
    return found.select(*BLOCK, "title_key", "years", "batch", F.col("m.end").withField("fresh", F.col("fresh")).alias("end"))


def content_pairs(groups: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """Pairs of different contents worth a look, scored: BLOCK, in_hub, left_* and right_* and the scores.

    Contents of one title with the same years and batch (a hub) qualify whatever their cities, so they form a star,
    and two hubs of close titles meet once. All other pairs must share a city, or a year together
    with the batch, and are joined on that. Both kinds of meeting are tokens of one join.
    """
    if rules.title + max(rules.year, rules.batch) >= rules.keep_score:
        raise ValueError("weights let a pair qualify without a shared city or year")
    contents = represented(groups)
    hubs = stored(hubs_of(contents), "hubs")
    same = groups.select(*BLOCK, F.col("title_key").alias("left_title"), F.col("title_key").alias("right_title")).distinct()
    titles = stored(similar_titles(groups, rules).unionByName(same.withColumn("title_similarity", F.lit(1.0))), "similar-titles")
    inside = (
        fact_join(contents.withColumnRenamed("end", "right"), hubs.withColumnRenamed("end", "left"), [*BLOCK, "title_key", "years", "batch"], "inner")
        .filter("left.content_id <> right.content_id and left.fresh")
        .select(*BLOCK, "left", "right", F.lit(1.0).alias("title_similarity"), F.lit(True).alias("in_hub"))
    )
    years = F.to_json(F.struct("years"))
    marked = contents.select(*BLOCK, "title_key", "end", F.concat(city_tokens("end."), year_tokens("end.")).alias("tokens"))
    entries = marked.select("*", F.explode("tokens").alias("token")).unionByName(
        hubs.select(*BLOCK, "title_key", "end", F.array().cast("array<string>").alias("tokens"), F.concat(F.lit("h:"), "batch", F.lit(":"), years).alias("token"))
    )

    def side(name: str) -> DataFrame:
        return entries.select(*BLOCK, "token", F.col("title_key").alias(f"{name}_title"), F.col("end").alias(name), F.col("tokens").alias(f"{name}_tokens"))

    at_hub = F.startswith("token", F.lit("h:"))
    near = F.col("title_similarity") * rules.title + (rules.year + rules.batch) >= rules.keep_score
    one_hub = F.col("left.years").eqNullSafe(F.col("right.years")) & (F.col("left.batch") == F.col("right.batch")) & (F.col("left.batch") != "")
    same_title = F.col("left_title") == F.col("right_title")
    first = F.get(F.array_intersect("left_tokens", "right_tokens"), F.lit(0)) == F.col("token")
    between = ~same_title & near
    # A pair whose hubs meet, or are one, follows from them.
    loose = first & ~(one_hub & near) & (~same_title | (F.col("left.content_id") < F.col("right.content_id")))
    met = (
        titles.join(side("left"), [*BLOCK, "left_title"])
        .join(side("right"), [*BLOCK, "right_title", "token"])
        .filter((F.col("left.fresh") | F.col("right.fresh")) & F.when(at_hub, between).otherwise(loose))
        .select(*BLOCK, "left", "right", "title_similarity", at_hub.alias("in_hub"))
    )
    parts = ("content", "id", "cities", "years", "batch", "job_id")
    ends = [F.col(f"{s}.{'content_id' if p == 'content' else p}").alias(f"{s}_{p}") for s in ("left", "right") for p in parts]
    both = inside.unionByName(met).select(*BLOCK, "title_similarity", "in_hub", *ends, F.lit(False).alias("same_hint"))
    scored = score_pairs(both, rules)
    return scored.filter(worth_review(rules) | (F.col("in_hub") & ~F.col("id_conflict")))


def score_pairs(pairs: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """Add batch_equal, score and decision.

    pairs: title_similarity, left_/right_ cities, years, batch, job_id, and same_hint.
    """
    ids = [F.coalesce(f"{s}_job_id", F.lit("")) for s in ("left", "right")]
    clash = (ids[0] != "") & (ids[1] != "") & (ids[0] != ids[1])
    batch_equal = (F.col("left_batch") != "") & (F.col("left_batch") == F.col("right_batch"))
    weighted = (
        F.col("title_similarity") * rules.title
        + F.col("city_similarity") * rules.city
        + F.col("year_similarity") * rules.year
        + F.when(F.col("batch_equal"), F.lit(rules.batch)).otherwise(0.0)
    )
    return (
        pairs.withColumns(
            {
                "city_similarity": jaccard_sets(F.col("left_cities"), F.col("right_cities")),
                "year_similarity": jaccard_sets(F.col("left_years"), F.col("right_years")),
                "batch_equal": F.coalesce(batch_equal, F.lit(False)),
                "id_conflict": clash,
            }
        )
        .withColumn(
            "score",
            F.when(F.col("id_conflict"), F.lit(0.0))
            .when(F.col("same_hint"), F.greatest(weighted, F.lit(rules.hint_score)))
            .otherwise(weighted),
        )
        .withColumn("decision", F.when(F.col("id_conflict"), "SEPARATE").otherwise("REVIEW"))
    )


def worth_review(rules: PairRules = PairRules()) -> Column:
    """Whether a scored pair is likely, or an id conflict that a reviewer might otherwise merge."""
    alike = (F.round("title_similarity", 4) >= rules.conflict_title) & (
        F.round("city_similarity", 4) >= rules.conflict_city
    )
    likely = F.col("same_hint") | (F.col("score") >= rules.keep_score)
    return F.when(F.col("id_conflict"), alike).otherwise(likely)


def prune_pairs(scored: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """Keep likely pairs, and id conflicts a reviewer might otherwise merge."""
    return scored.filter(worth_review(rules))


def candidate_pairs(entities: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """Scored, pruned candidates: stars inside contents and pairs of representatives across them.

    Members and contents are written once; every later step reads these tables, not the entities.
    """
    members = stored(contents(entities), "members")
    groups = stored(content_groups(members), "contents")
    across = content_pairs(groups, rules).select(
        *BLOCK,
        F.least("left_id", "right_id").alias("left_id"),
        F.greatest("left_id", "right_id").alias("right_id"),
        "title_similarity", "city_similarity", "year_similarity", "batch_equal", "score", "decision",
    )
    return star_pairs(members, rules).unionByName(across)


def upsert_pairs(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """New assessments replace older ones of the same ordered pair unless already reviewed."""
    key = ["left_id", "right_id"]
    ordered = pairs.withColumns(
        {"left_id": F.least(*key), "right_id": F.greatest(*key), "reviewed_at": F.lit(None).cast("timestamp")}
    )
    columns = [*key, "score", "decision", "reviewed_at"]
    both = (
        ordered.select(*columns, F.lit(1).alias("age"))
        .unionByName(existing.select(*columns, F.when(F.col("reviewed_at").isNotNull(), 0).otherwise(2).alias("age")))
    )
    value = F.struct("age", *[F.col(c) for c in columns[2:]])
    return both.groupBy(*key).agg(F.min(value).alias("v")).select(*key, *[f"v.{c}" for c in columns[2:]])


def review_pairs(pairs: DataFrame, commands: DataFrame, min_reason: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejected commands): decision, reason and time of the latest review per pair.

    commands: left_id, right_id, new_decision, reason, at.
    """
    key = ["left_id", "right_id"]
    known = pairs.select(*key).withColumn("_known", F.lit(True))
    judged = commands.join(known, key, "left").withColumn(
        "error",
        F.when(F.col("_known").isNull(), "not_found")
        .when(F.length(F.trim("reason")) < min_reason, "reason_too_short")
        .when(~F.col("new_decision").isin("MERGE", "SEPARATE", "REVIEW"), "bad_decision"),
    )
    last = (
        judged.filter("error is null")
        .groupBy(*key)
        .agg(F.max(F.struct("at", "new_decision", "reason")).alias("c"))
    )
    out = pairs.join(last, key, "left").select(
        *[c for c in pairs.columns if c not in ("decision", "reviewed_at", "reason")],
        F.coalesce("c.new_decision", "decision").alias("decision"),
        F.col("c.reason").alias("reason"),
        F.coalesce("c.at", "reviewed_at").alias("reviewed_at") if "reviewed_at" in pairs.columns else F.col("c.at").alias("reviewed_at"),
    )
    return out, judged.filter("error is not null").select(*key, "error")
