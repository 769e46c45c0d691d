"""Replicated logs as relations: append, conflicts, commit, votes, application, snapshots.

A log has columns index (dense from 1), term and what the commands need. Entry 0 is
implied: term 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, PUT, SNAPSHOT_ENTRIES, NotLeaderError
from .state import visible_state


#: Nodes of a cluster that a log is compared with at once, at most.
MOST_PEERS = 10_000


def majority(n: int) -> int:
    return n // 2 + 1


def append(log: DataFrame, commands: DataFrame, term: int, is_leader: bool = True) -> DataFrame:
    """log with the commands (ordered by pos, from 0) at the next indexes. Only a leader appends."""
    if not is_leader:
        raise NotLeaderError("not the leader")
    last = log.agg(F.coalesce(F.max("index"), F.lit(0)).alias("_last"))
    rest = [c for c in log.columns if c not in ("index", "term")]
    new = commands.join(F.broadcast(last)).select((F.col("_last") + 1 + F.col("pos")).alias("index"), F.lit(term).cast("long").alias("term"), *rest)
    return log.unionByName(new)


def tail(log: DataFrame) -> DataFrame:
    """One row: last index and last term, 0 of an empty log."""
    return log.agg(F.coalesce(F.max("index"), F.lit(0)).alias("last_index"), F.coalesce(F.max_by("term", "index"), F.lit(0)).alias("last_term"))


def pending(log: DataFrame, next_index: DataFrame) -> DataFrame:
    """(peer, index, term): entries that each peer (peer, next_index) is still to get.

    Peers are sent to all tasks, so there may be ``MOST_PEERS`` at most; more is an error.
    """
    if next_index.limit(MOST_PEERS + 1).count() > MOST_PEERS:
        raise ValueError(f"more than {MOST_PEERS} peers")
    return F.broadcast(next_index).join(log.select("index", "term"), F.col("index") >= F.col("next_index")).select("peer", "index", "term")


def previous_matches(log: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, ok, conflict_index, conflict_term) for append requests (request, prev_index, prev_term).

    Without the entry before: the index after the last. With another term there: that
    term, and its first index in the log.
    """
    here = log.select(F.col("index").alias("prev_index"), F.col("term").alias("here"))
    first_of_term = log.groupBy(F.col("term").alias("here")).agg(F.min("index").alias("first"))
    checked = requests.join(here, "prev_index", "left").join(first_of_term, "here", "left").join(F.broadcast(tail(log)))
    none, other = F.col("here").isNull() & (F.col("prev_index") > 0), F.col("here") != F.col("prev_term")
    ok = (F.col("prev_index") == 0) | F.coalesce(F.col("here") == F.col("prev_term"), F.lit(False))
    return checked.select("request", ok.alias("ok"), F.when(~ok & none, F.col("last_index") + 1).when(~ok & other, F.col("first")).alias("conflict_index"), F.when(~ok & other, F.col("here")).alias("conflict_term"))


def conflict_index(log: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: the first index where both have an entry of another term, or null."""
    both = log.select("index", F.col("term").alias("own")).join(entries.select("index", "term"), "index")
    return both.where("own <> term").agg(F.min("index").alias("first_conflict"))


def accept(log: DataFrame, entries: DataFrame) -> DataFrame:
    """A follower's log after an accepted append: cut at the first conflict, missing entries added."""
    kept = log.join(F.broadcast(conflict_index(log, entries))).where("first_conflict IS NULL OR index < first_conflict").drop("first_conflict")
    return kept.unionByName(entries.join(kept.select("index"), "index", "left_anti").select(*log.columns))


def commit_index(log: DataFrame, matches: DataFrame, term: int, commit: int = 0) -> DataFrame:
    """One row: the commit index after (peer, match_index) of all nodes, the leader's included.

    The highest index that a majority has, if it is of the current term and not below
    the present commit index. One row for each node.
    """
    ranked = matches.agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"))
    reached = ranked.select(F.element_at("m", (F.floor(F.size("m") / 2) + 1).cast("int")).alias("index"))
    good = reached.join(log.select("index", "term"), "index").where(F.col("term") == term).select("index")
    return good.agg(F.greatest(F.coalesce(F.max("index"), F.lit(0)), F.lit(commit)).cast("long").alias("commit_index"))


def up_to_date(last_term: Column, last_index: Column, own_term: Column, own_index: Column) -> Column:
    """A candidate's log is at least as up to date as the voter's."""
    return (last_term > own_term) | ((last_term == own_term) & (last_index >= own_index))


def vote(requests: DataFrame) -> DataFrame:
    """requests with ``granted``: term not behind, no vote for another in the term, log up to date.

    Columns: term, candidate, last_index, last_term of the request; own_term, voted_for,
    own_last_index, own_last_term of the voter.
    """
    free = (F.col("term") > F.col("own_term")) | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    newer = up_to_date(F.col("last_term"), F.col("last_index"), F.col("own_last_term"), F.col("own_last_index"))
    return requests.withColumn("granted", (F.col("term") >= F.col("own_term")) & free & newer)


def tally(votes: DataFrame, nodes: int) -> DataFrame:
    """(candidate, votes, elected) of granted votes, the candidate's own among them."""
    return votes.groupBy("candidate").agg(F.sum(F.col("granted").cast("long")).alias("votes")).withColumn("elected", F.col("votes") >= majority(nodes))


def apply(log: DataFrame, upto: Column) -> DataFrame:
    """The state after applying the entries up to an index, in order: (key, index, value).

    The log has decoded commands: key, op, value. The last command of a key decides, so
    order needs no sequential pass. A command of an unknown type is an error.
    """
    changes = log.where(F.col("index") <= upto).select("key", F.col("index").alias("seq"), _known_op().alias("op"), "value")
    return visible_state(changes).select("key", F.col("seq").alias("index"), "value")


def _known_op() -> Column:
    """op as an int; a type that is neither put nor delete is an error."""
    op = F.col("op").cast("int")
    wrong = F.raise_error(F.concat(F.lit("unknown command type "), F.coalesce(op.cast("string"), F.lit("null")))).cast("int")
    return F.when(op.isin(PUT, DELETE), op).otherwise(wrong)


def snapshot(log: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """The state at an index, and the log that stays: entries from that index on."""
    return apply(log, F.lit(at)), log.where(F.col("index") >= at)


def restore(state: DataFrame, log: DataFrame, at: int) -> DataFrame:
    """A snapshot at an index with the later log on top: what applying the whole log gives."""
    base = state.select("key", F.col("index").alias("seq"), F.lit(PUT).alias("op"), "value")
    later = log.where(F.col("index") > at).select("key", F.col("index").alias("seq"), _known_op().alias("op"), "value")
    return visible_state(base.unionByName(later)).select("key", F.col("seq").alias("index"), "value")


def should_snapshot(log: DataFrame, most: int = SNAPSHOT_ENTRIES) -> DataFrame:
    return log.agg((F.count("*") > most).alias("due"), F.count("*").alias("entries"))
