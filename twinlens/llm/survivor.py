"""The surviving record of each group of duplicates (problem 3).

A latent truth model with two-sided source quality decides which values are true: each source has a
sensitivity, the chance that it states a true value it can know of, and a specificity, the chance that it leaves out
a false one. Expectation-maximisation infers both together with the truth of every value, and every value judged true
is kept. Values enter by their pattern (the sources that know, those of them that state the value), and the
patterns of all groups are counted in a written table: a round scores the patterns there and brings back
four sums for each source, so neither groups nor patterns go to the driver, and the number of sources is free.

Three fields are judged so. Pages and labels may have several values, stated by the engines that found the group. The third
is which members hold a picture at all: its sources are the three statements of each record, on its download, its width and its
height. Of the members judged true, an exact check keeps those without error and with width and height above 0; the
pattern of greatest probability is always judged true, so the check never misses a record that would pass it. Fields with one value
come from these members in the order of preference: the greatest area, then the latest fetch (unknown is oldest), then the
least id; the address is the first non-empty one in that order, so each field takes the best record that has it.

Defined cases: a group needs two different members and a usable one (no error, width and height
above 0), else it has no row; members that don't exist count as different but not usable; null
members are left out; a repeated member or a group delivered again changes nothing; a
group without an address has '' as address id and null as address; an engine of null states nothing; extra columns
don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.workspace import Workspace

#: Rounds at most; fewer where nothing moves by more than SETTLED.
ROUNDS = 10
SETTLED = 1e-8
#: Beta priors (true, false): sensitivity, false positives (1 - specificity), and truth.
PRIOR_SENSITIVITY = (5.0, 5.0)
PRIOR_FALSE_POSITIVE = (1.0, 19.0)
PRIOR_TRUTH = (5.0, 5.0)
#: Where every source starts.
START = {"sensitivity": 0.6, "false_positive": 0.1, "truth": 0.5}
MULTI_VALUED = ("page_url", "engine_label")
MEMBER = "member"
TRUE = 0.5
_PRIOR = "\x00prior"


class Quality:
    """Two-sided quality of the sources of each field."""

    def __init__(self):
        self.truth: dict[str, float] = {}
        self.sensitivity: dict[tuple[str, str], float] = {}
        self.false_positive: dict[tuple[str, str], float] = {}

    def all(self) -> list[float]:
        return [*self.truth.values(), *self.sensitivity.values(), *self.false_positive.values()]

    def probability(self, field: Column, knows: Column, states: Column) -> Column:
        """Chance that a value stated by ``states`` of the sources ``knows`` is true."""
        out = F.lit(None).cast("double")
        for name, truth in self.truth.items():
            # all numbers in maps: as literals of their own they would make each round's generated code another one to compile
            said, silent = [F.lit(_PRIOR), F.lit(log(truth / (1 - truth)))], [F.lit(_PRIOR), F.lit(0.0)]
            for (f, source), a in self.sensitivity.items():
                if f == name:
                    b = self.false_positive[f, source]
                    said += [F.lit(source), F.lit(log(a / b))]
                    silent += [F.lit(source), F.lit(log((1 - a) / (1 - b)))]
            yes, no = F.create_map(*said), F.create_map(*silent)
            odds = F.aggregate(knows, yes[_PRIOR], lambda sum_, s: sum_ + F.coalesce(F.when(F.array_contains(states, s), yes[s]).otherwise(no[s]), F.lit(0.0)))
            out = F.when(field == name, 1 / (1 + F.exp(-odds))).otherwise(out)
        return out


def fit_quality(patterns: DataFrame, rounds: int = ROUNDS) -> Quality:
    """``patterns`` is a written table of field, knows, states and n."""
    q = Quality()
    sources = patterns.select("field", F.explode("knows").alias("source")).distinct().collect()
    for r in patterns.select("field").distinct().collect():
        q.truth[r["field"]] = START["truth"]
    for r in sources:
        q.sensitivity[r["field"], r["source"]] = START["sensitivity"]
        q.false_positive[r["field"], r["source"]] = START["false_positive"]
    for _ in range(rounds if q.truth else 0):
        scored = patterns.withColumn("p", q.probability(F.col("field"), F.col("knows"), F.col("states")))
        # null stands for the field as a whole
        each = scored.select("field", "n", "p", F.explode(F.concat("knows", F.array(F.lit(None).cast("string")))).alias("source"), "states")
        t, f, s = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p")), F.coalesce(F.array_contains("states", F.col("source")).cast("int"), F.lit(0))
        before = q.all()
        sums = each.groupBy("field", "source").agg(F.sum(t * s).alias("ts"), F.sum(t).alias("t"), F.sum(f * s).alias("fs"), F.sum(f).alias("f"))
        for r in sums.collect():
            if r["source"] is None:
                a, b = PRIOR_TRUTH
                q.truth[r["field"]] = (r["t"] + a) / (r["t"] + r["f"] + a + b)
                continue
            key = r["field"], r["source"]
            a, b = PRIOR_SENSITIVITY
            q.sensitivity[key] = (r["ts"] + a) / (r["t"] + a + b)
            a, b = PRIOR_FALSE_POSITIVE
            q.false_positive[key] = (r["fs"] + a) / (r["f"] + a + b)
        if max(abs(x - y) for x, y in zip(before, q.all())) < SETTLED:
            break
    return q


def member_rows(cards: DataFrame, candidates: DataFrame) -> DataFrame:
    """(card_key, cid, the candidate's fields, and what its three statements say) of the groups' different members."""
    members = (
        cards.where(F.col("card_key").isNotNull())
        .select("card_key", F.explode("member_cids").alias("cid"))
        .where(F.col("cid").isNotNull())
        .distinct()
    )
    sound = {"download": F.col("error").isNull(), "width": F.col("width") > 0, "height": F.col("height") > 0}
    knows = F.array_compact(F.array(*(F.when(v.isNotNull(), F.lit(k)) for k, v in sound.items())))
    states = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in sound.items())))
    usable = F.coalesce(sound["download"] & sound["width"] & sound["height"], F.lit(False))
    fields = candidates.select("cid", "engine", "url", "width", "height", "fetched_at", *MULTI_VALUED, knows.alias("knows"), states.alias("states"), usable.alias("usable"))
    return members.join(fields.hint("merge"), "cid", "left")


def _patterns(df: DataFrame) -> DataFrame:
    return df.groupBy("field", "knows", "states").agg(F.count("*").alias("n"))


class Survivors:
    """The members of all groups and the values judged true."""

    def __init__(self, cards: DataFrame, candidates: DataFrame, rounds: int = ROUNDS):
        ws = Workspace(cards.sparkSession, "survivor")
        rows = ws.save(member_rows(cards, candidates), "members")
        said = rows.where("knows IS NOT NULL").withColumn("field", F.lit(MEMBER))
        patterns = ws.save(_patterns(said), "patterns")
        self.member_quality = fit_quality(patterns, rounds)
        p = self.member_quality.probability(F.col("field"), F.col("knows"), F.col("states"))
        best = patterns.select(F.max(p)).first()[0]
        judged = said.where(p >= min(TRUE, best if best is not None else TRUE) - 1e-12)
        self.kept = judged.where("usable").select("card_key", "cid", "engine", "url", "width", "height", "fetched_at", *MULTI_VALUED)
        self.counted = rows.groupBy("card_key").agg(F.count("*").alias("members"))
        self.values = ws.save(self._values(), "values")
        self.quality = fit_quality(ws.save(_patterns(self.values), "patterns"), rounds)

    def _values(self) -> DataFrame:
        """(card_key, field, value, knows, states)."""
        claims = self.kept.where("engine IS NOT NULL")
        stated = claims.select("card_key", "engine", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in MULTI_VALUED))).alias("x"))
        # sets of engines, of which there are few
        each = stated.where("x.value <> ''").groupBy("card_key", "x.field", "x.value").agg(F.array_sort(F.collect_set("engine")).alias("states"))
        knows = claims.groupBy("card_key").agg(F.array_sort(F.collect_set("engine")).alias("knows"))
        return each.join(knows.hint("merge"), "card_key").select("card_key", "field", "value", "knows", "states")

    def true_values(self) -> DataFrame:
        """(card_key, field, value): every value of a multi-valued field judged true."""
        p = self.quality.probability(F.col("field"), F.col("knows"), F.col("states"))
        return self.values.where(p >= TRUE).select("card_key", "field", "value")

    def records(self) -> DataFrame:
        """One row a group: (card_key, representative_cid, best_width, best_height, url_cid, best_url, members, and for each
        multi-valued field the number of values judged true and the least of them)."""
        oldest = F.lit(2**63 - 1)
        order = [
            (-(F.col("width").cast("bigint") * F.col("height"))).alias("o1"),
            F.coalesce(-F.unix_micros(F.col("fetched_at").cast("timestamp")), oldest).alias("o2"),
            F.col("cid").alias("o3"),
        ]
        best = self.kept.groupBy("card_key").agg(
            F.min(F.struct(*order, "width", "height")).alias("rep"), F.min(F.when(F.col("url") != "", F.struct(*order, "url"))).alias("addr")
        )
        true = self.true_values().groupBy("card_key").agg(
            *(F.count_if(F.col("field") == c).alias(f"{c}_values") for c in MULTI_VALUED), *(F.min(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in MULTI_VALUED)
        )
        some = self.counted.where("members >= 2").join(best.hint("merge"), "card_key")
        return some.join(true.hint("merge"), "card_key", "left").select(
            "card_key",
            F.col("rep.o3").alias("representative_cid"),
            F.col("rep.width").alias("best_width"),
            F.col("rep.height").alias("best_height"),
            F.coalesce("addr.o3", F.lit("")).alias("url_cid"),
            F.col("addr.url").alias("best_url"),
            "members",
            F.coalesce("page_url_values", F.lit(0)).alias("pages"),
            F.col("page_url").alias("first_page"),
            F.coalesce("engine_label_values", F.lit(0)).alias("labels"),
            F.col("engine_label").alias("first_label"),
        )


def surviving_records(cards: DataFrame, candidates: DataFrame) -> DataFrame:
    return Survivors(cards, candidates).records()
