"""Who is who: persons and their distinct ids from identity events."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.properties import json_text
from strandline.session import materialize

# The events that join two ids, and where the other id stands.
JOINS = {"$identify": "$anon_distinct_id", "$create_alias": "alias", "$merge_dangerously": "alias"}


def other_id() -> Column:
    """The second id of an identity event; null if it is missing, empty, no string or the same."""
    found = F.coalesce(*(F.when(F.col("event") == e, F.from_json("properties", f"struct<`{k}`:string>")[k]) for e, k in JOINS.items()))
    return F.when((found != "") & (found != F.col("distinct_id")), found)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for an edge list (a, b).

    Alternates two local steps until nothing changes: link every larger neighbour to the smallest
    one, then every smaller one. Each step is one aggregation and one join on the node; a node
    with very many neighbours is never gathered in one place. Rounds grow with the logarithm of
    the longest chain; each is written down, so a lost executor repeats one round at most.
    """
    current = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    changed = True
    while changed:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        down = larger.select(F.col("b").alias("u"), F.col("a").alias("v")).where("u <> v").distinct()
        smallest = down.groupBy("u").agg(F.min("v").alias("m"))
        pairs = down.join(smallest, "u")
        linked = pairs.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(smallest.select(F.col("m").alias("a"), F.col("u").alias("b")))
        following = materialize(linked.where("a <> b").distinct())
        changed = following.exceptAll(current).limit(1).count() + current.exceptAll(following).limit(1).count() > 0
        current = following
    members = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()


class People:
    """The persons of one component, as identity events are applied in order.

    Ids are joined into trees: the root stands for a person, and every edge holds the event that
    moved what lies below it. seq grows, so an id's latest move is the largest on its way up. A
    merge is one new root, whatever the number of ids, and paths are shortened as they are walked.
    """

    def __init__(self) -> None:
        self.up: list[tuple[int, int]] = []  # parent (itself for a root) and seq of the edge to it
        self.node: dict[str, int] = {}
        self.name: dict[int, str] = {}
        self.known: dict[str, dict] = {}

    def _root(self, node: int) -> tuple[int, int]:
        """The root above a node, and the largest seq on the way."""
        path = []
        while self.up[node][0] != node:
            path.append(node)
            node = self.up[node][0]
        latest = 0
        for below in reversed(path):
            latest = max(latest, self.up[below][1])
            self.up[below] = (node, latest)
        return node, latest

    def owner(self, distinct_id: str) -> str:
        return self.name[self._root(self.node[distinct_id])[0]]

    def moved(self, distinct_id: str) -> int:
        """seq of the event that last moved the id; 0 if none did."""
        return self._root(self.node[distinct_id])[1]

    def ensure(self, distinct_id: str, at: int) -> str:
        """The person of an id; a new one is named after it and created at the event's time."""
        if distinct_id not in self.node:
            new = len(self.up)
            self.up.append((new, 0))
            self.node[distinct_id], self.name[new] = new, distinct_id
            self.known[distinct_id] = {"created": at, "identified": False, "properties": {}, "first_key": distinct_id, "last_seen": None}
        return self.owner(distinct_id)

    def merge(self, loser_id: str, winner_id: str, at: int, guard: str, seq: int) -> None:
        """One person of two, unless the guard refuses: the winner's properties win, the older
        side's creation and first key survive, all ids of the loser move."""
        winner, loser = self.ensure(winner_id, at), self.ensure(loser_id, at)
        if winner == loser:
            return
        roots = {"winner": self._root(self.node[winner_id])[0], "loser": self._root(self.node[loser_id])[0]}
        if self.known[loser]["identified"]:
            if guard == "$identify" or guard == "$create_alias" and self.known[winner]["identified"]:
                return
            if guard == "$create_alias":
                winner, loser = loser, winner
                roots = {"winner": roots["loser"], "loser": roots["winner"]}
        kept, gone = self.known[winner], self.known.pop(loser)
        kept["properties"] = gone["properties"] | kept["properties"]
        if gone["created"] < kept["created"]:
            kept["created"], kept["first_key"] = gone["created"], gone["first_key"]
        kept["last_seen"] = max((x for x in (kept["last_seen"], gone["last_seen"]) if x is not None), default=None)
        kept["identified"] = True
        new = len(self.up)
        self.up.append((new, 0))
        self.up[roots["winner"]], self.up[roots["loser"]] = (new, 0), (new, seq)
        self.name[new] = winner

    def apply(self, seq: int, event: str, distinct_id: str, at: int, other: str | None, document: str | None) -> None:
        person = self.known[self.ensure(distinct_id, at)]
        person["last_seen"] = at if person["last_seen"] is None else max(person["last_seen"], at)
        if event in JOINS and other:
            self.merge(other, distinct_id, at, event, seq)
        if event in ("$identify", "$create_alias"):
            self.known[self.owner(distinct_id)]["identified"] = True
        if not document:
            return
        changes = json.loads(document)
        held = self.known[self.owner(distinct_id)]["properties"]
        once, now, gone = (changes.get(k) for k in ("$set_once", "$set", "$unset"))
        if isinstance(once, dict):
            held |= {k: v for k, v in once.items() if k not in held}
        if isinstance(now, dict):
            held |= now
        for key in gone if isinstance(gone, list) else []:
            if isinstance(key, str):
                held.pop(key, None)


#: Rows that are handed back together, of many small components or of one.
ROWS_OUT = 10_000
COLUMNS = "project_id string, distinct_id string, person_id string, seq long, is_person boolean, created_us long, is_identified boolean, properties string, first_seen_key string, last_seen_us long"


def outcome(project: str, people: People) -> list[tuple]:
    """A row per distinct id; the row whose id names the person carries the person's figures."""
    out = []
    for i in people.node:
        person = people.owner(i)
        p = people.known[person] if i == person else None
        own = (p["created"], p["identified"], json.dumps(p["properties"], ensure_ascii=False), p["first_key"], p["last_seen"]) if p else (None,) * 5
        out.append((project, i, person, people.moved(i), p is not None, *own))
    return out


def fold(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The outcome of each component's events, which come one component after the other in order of
    seq. What is held is a component's persons and ids, not its events."""
    columns = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    last, people, out = None, People(), []
    for frame in frames:
        for r in frame.itertuples(index=False):
            if (r.project_id, r.component) != last:
                if last is not None:
                    out += outcome(last[0], people)
                last, people = (r.project_id, r.component), People()
                if len(out) >= ROWS_OUT:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            people.apply(int(r.seq), r.event, r.distinct_id, int(r.at), r.other, r.changes)
    if last is not None:
        out += outcome(last[0], people)
    if out:
        yield pd.DataFrame(out, columns=columns)


def resolve(events: DataFrame) -> DataFrame:
    """Persons and ids after all `events` (project_id, distinct_id, event, at, properties, seq).

    seq gives the order in which events count. Refusals between two identified persons depend on
    that order, so the events of ids that are connected at all are folded one after the other, in
    one task, which reads them sorted and holds the persons only. Before that an id's plain events
    are reduced to its first and its latest, and so are repeats of an identity event: what the first
    one did, or was refused, is so for good. Columns: see COLUMNS.
    """
    other = other_id()
    changing = F.col("properties").rlike(r'"\$(set|set_once|unset)"')
    own = events.where(F.col("distinct_id").isNotNull()).withColumn("other", other).withColumn("changes", F.when(changing, F.col("properties")))
    joins = F.col("event").isin(list(JOINS))
    told = own.where(joins)
    first = told.groupBy(F.col("project_id").alias("f_project"), F.col("distinct_id").alias("f_id"), F.col("event").alias("f_event"), F.col("other").alias("f_other")).agg(F.min("seq").alias("f_seq"))
    same = (F.col("project_id") == F.col("f_project")) & (F.col("distinct_id") == F.col("f_id")) & (F.col("event") == F.col("f_event")) & F.col("other").eqNullSafe(F.col("f_other"))
    again = F.coalesce(F.col("seq") > F.col("f_seq"), F.lit(False))
    once = told.join(first, same, "left").withColumns({"event": F.when(again, F.lit("")).otherwise(F.col("event")), "other": F.when(~again, F.col("other"))})
    own = own.where(~joins).unionByName(once.select(*own.columns))
    telling = F.col("event").isin(list(JOINS)) | F.col("changes").isNotNull()
    plain = own.where(~telling).groupBy("project_id", "distinct_id").agg(F.min(F.struct("seq", "at")).alias("first"), F.max(F.struct("at", "seq")).alias("last"))
    ends = plain.select("project_id", "distinct_id", F.explode(F.array(F.struct("first.seq", "first.at"), F.struct("last.seq", "last.at"))).alias("e")).select("project_id", "distinct_id", "e.seq", "e.at", F.lit("").alias("event"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("changes"))
    stream = own.where(telling).select("project_id", "distinct_id", "seq", "at", "event", "other", "changes").unionByName(ends)
    node = lambda c: F.concat(F.col("project_id"), F.lit("\u001f"), F.col(c))
    edges = own.where(F.col("other").isNotNull()).select(node("distinct_id").alias("a"), node("other").alias("b"))
    grouped = stream.withColumn("n", node("distinct_id")).join(components(edges), F.col("n") == F.col("node"), "left")
    placed = grouped.withColumn("component", F.coalesce("component", "n")).select("project_id", "component", "seq", "at", "event", "distinct_id", "other", "changes")
    return placed.repartition("project_id", "component").sortWithinPartitions("project_id", "component", "seq").mapInPandas(fold, COLUMNS)


def overrides(resolved: DataFrame) -> DataFrame:
    """project_id, distinct_id, person_id where the two differ."""
    return resolved.where("person_id <> distinct_id").select("project_id", "distinct_id", "person_id")


def latest(distinct_ids: DataFrame) -> DataFrame:
    """The mapping that holds: per distinct id the row with the highest seq."""
    order = Window.partitionBy("project_id", "distinct_id").orderBy(F.desc("seq"), F.desc("person_id"))
    return distinct_ids.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Overrides after a feed of changes (project_id, distinct_id, person_id, seq): the latest
    change of an id replaces it; one that maps an id to itself removes it."""
    new = latest(changes).select("project_id", "distinct_id", "person_id")
    kept = current.join(new, ["project_id", "distinct_id"], "left_anti").select("project_id", "distinct_id", "person_id")
    return kept.unionByName(new.where("person_id <> distinct_id"))


def groups(events: DataFrame) -> DataFrame:
    """project_id, group_type, group_key, properties (map): each key's latest value from
    $groupidentify events, by seq; a numeric group key counts as its text."""
    told = events.where(F.col("event") == "$groupidentify").select("project_id", "seq", json_text(F.col("properties"), "$group_type").alias("group_type"), json_text(F.col("properties"), "$group_key").alias("group_key"), F.from_json(json_text(F.col("properties"), "$group_set"), "map<string,string>").alias("set"))
    known = told.where(F.col("group_type").isNotNull() & F.col("group_key").isNotNull())
    members = known.select("project_id", "group_type", "group_key", "seq", F.explode_outer("set").alias("k", "v"))
    newest = members.groupBy("project_id", "group_type", "group_key", "k").agg(F.max_by("v", "seq").alias("v"))
    return newest.groupBy("project_id", "group_type", "group_key").agg(F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("properties"))


def summaries(wanted: DataFrame, people: DataFrame, distinct_ids: DataFrame) -> DataFrame:
    """person_id, display_name, distinct_ids (at most ten) of the asked persons; one that was never
    seen is kept, with its id as its name."""
    owned = latest(distinct_ids).groupBy(F.col("person_id").alias("o_person")).agg(F.slice(F.sort_array(F.collect_set("distinct_id")), 1, 10).alias("distinct_ids"))
    text = lambda k: F.nullif(json_text(F.col("properties"), k), F.lit(""))
    known = people.select(F.col("id").alias("k_person"), F.coalesce(text("email"), text("name")).alias("name"))
    joined = wanted.select("person_id").join(owned, F.col("person_id") == F.col("o_person"), "left").join(known, F.col("person_id") == F.col("k_person"), "left")
    return joined.select("person_id", F.coalesce("name", F.get("distinct_ids", F.lit(0)), "person_id").alias("display_name"), F.coalesce("distinct_ids", F.array(F.col("person_id"))).alias("distinct_ids"))

