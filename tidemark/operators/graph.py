"""The company, director, donor, trust and party graph as tables, and connection scores as a chain of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.params import DEFAULT, Params
from tidemark.operators.similarity import stored


def last_donations(donations: DataFrame) -> DataFrame:
    """One row per (donor, trust): the last by id, as a graph keeps one edge per pair; no window, so a hot pair costs nothing."""
    return donations.groupBy("donor", "trust").agg(F.max_by(F.struct("amount", "donated"), "id").alias("x"), F.min("id").alias("first_id")).select("donor", "trust", "x.amount", "x.donated", "first_id")


def trust_parties(donations: DataFrame) -> DataFrame:
    """Each trust's first party."""
    return donations.groupBy("trust").agg(F.min_by("party", "id").alias("party"))


def board_seats(company_boards: DataFrame, donor_boards: DataFrame) -> DataFrame:
    """din, seats: the companies and donors that a director sits with, one at least."""
    every = company_boards.select("din", F.concat(F.lit("company:"), "scrip_code").alias("at")).unionByName(donor_boards.select("din", F.concat(F.lit("donor:"), F.col("donor").cast("string")).alias("at")))
    return every.distinct().groupBy("din").agg(F.count("at").alias("seats"))


def connections(company_boards, donor_boards, donations, directors, as_of_year: int, params: Params = DEFAULT, elections: DataFrame | None = None) -> DataFrame:
    """scrip_code, din, donor, seats, amount, trust, party, score: each company, director and donor that a path of three edges joins.

    elections: parties whose state votes soon, as (party). A donor's amount is its largest recent one; donors under the
    minimum drop out.
    """
    edges = last_donations(donations)
    recent = edges.groupBy("donor").agg(F.max(F.when(F.col("donated") >= as_of_year - params.max_years, F.col("amount"))).alias("amount"), F.min_by("trust", "first_id").alias("trust"))
    recent = recent.filter(F.col("amount") >= params.min_donation).join(trust_parties(donations), "trust")
    tier = F.lit(params.tier_floor)
    for least, value in reversed(params.tiers):
        tier = F.when(F.col("amount") >= least, value).otherwise(tier)
    a, b, c = params.weights
    rows = company_boards.join(donor_boards, "din").join(recent, "donor").join(board_seats(company_boards, donor_boards), "din").join(directors.select("din", "is_bureaucrat"), "din")
    score = a / F.greatest(F.col("seats"), F.lit(1)) + b / params.path_length + c * tier
    score = score * F.when(F.col("is_bureaucrat"), params.bureaucrat_multiplier).otherwise(1.0)
    if elections is not None:
        rows = rows.join(F.broadcast(elections.select("party", F.lit(params.election_multiplier).alias("boost"))), "party", "left")
        score = score * F.coalesce("boost", F.lit(1.0))
    return rows.select("scrip_code", "din", "donor", "seats", "amount", "trust", "party", F.round(score, 3).alias("score"))


def top_connections(rows: DataFrame) -> DataFrame:
    """Each company's best connection; of equals the smallest director, then donor."""
    best = F.max(F.struct("score", (-F.col("din")).alias("d"), (-F.col("donor")).alias("o"), "seats", "amount", "party")).alias("x")
    return rows.groupBy("scrip_code").agg(best).select("scrip_code", (-F.col("x.d")).alias("din"), (-F.col("x.o")).alias("donor"), "x.seats", "x.amount", "x.party", "x.score")


def paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Simple undirected paths of up to hops edges from the vertices of starts(id): path (array), length."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = starts.select(F.array("id").alias("path"))
    out = None
    for k in range(1, hops + 1):
        front = front.withColumn("src", F.element_at("path", -1)).join(both, "src").filter(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"))
        step = front.withColumn("length", F.lit(k))
        out = step if out is None else out.unionByName(step)
    return out


def paths_between(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int) -> DataFrame:
    """Simple undirected paths of 1 to hops edges from starts(id) to ends(id): path (array), length.

    Both sides grow half of the way and meet: a path of L edges is one of the first L // 2, rounded up, from its start, and the rest from its
    end, so that what grows is bounded by the square root of what paths of that length could be. A vertex in which very
    many meet is a join on its id, which adaptive execution splits. An end that is no vertex of the edges, or a start
    itself, has no paths.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = stored(both.filter("src <> dst"), "edges")

    def grown(seeds: DataFrame, steps: int) -> list[DataFrame]:
        levels = [seeds.select("id").distinct().join(both.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select(F.array("id").alias("path"), F.col("id").alias("at"))]
        for _ in range(steps):
            more = levels[-1].join(both, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
            levels.append(stored(more.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at")), "half_paths"))
        return levels

    first, last = grown(starts, -(-hops // 2)), grown(ends, hops // 2)
    out = None
    for length in range(1, hops + 1):
        a, b = first[-(-length // 2)], last[length // 2]
        met = a.join(b.select(F.col("path").alias("back"), "at"), "at").filter(F.size(F.array_intersect("path", "back")) == 1)
        met = met.select(F.concat("path", F.slice(F.reverse("back"), 2, hops)).alias("path"), F.lit(length).alias("length"))
        out = met if out is None else out.unionByName(met)
    return out


def vertices_and_edges(companies, company_boards, donor_boards, donations, directors) -> tuple[DataFrame, DataFrame]:
    """The whole graph: vertices (id, kind) and edges (src, dst, kind), built from the watched companies outward."""
    watched = companies.filter("in_watchlist").select("scrip_code")
    boards = company_boards.join(watched, "scrip_code", "left_semi")
    seated = boards.select("din").distinct()
    donor_seats = donor_boards.join(seated, "din", "left_semi")
    edges = [
        boards.select(F.concat(F.lit("director:"), "din").alias("src"), F.concat(F.lit("company:"), "scrip_code").alias("dst"), F.lit("SITS_ON_BOARD").alias("kind")),
        donor_seats.select(F.concat(F.lit("director:"), "din").alias("src"), F.concat(F.lit("donor:"), "donor").alias("dst"), F.lit("SITS_ON_BOARD").alias("kind")),
        donations.select(F.concat(F.lit("donor:"), "donor").alias("src"), F.concat(F.lit("trust:"), "trust").alias("dst"), F.lit("DONATED_TO").alias("kind")),
        donations.select(F.concat(F.lit("trust:"), "trust").alias("src"), F.concat(F.lit("party:"), "party").alias("dst"), F.lit("FUNDED").alias("kind")),
    ]
    ids = [
        watched.select(F.concat(F.lit("company:"), "scrip_code").alias("id"), F.lit("ListedCompany").alias("kind")),
        seated.select(F.concat(F.lit("director:"), "din").alias("id"), F.lit("Director").alias("kind")),
        donations.select(F.concat(F.lit("donor:"), "donor").alias("id"), F.lit("DonorCompany").alias("kind")),
        donations.select(F.concat(F.lit("trust:"), "trust").alias("id"), F.lit("ElectoralTrust").alias("kind")),
        donations.select(F.concat(F.lit("party:"), "party").alias("id"), F.lit("PoliticalParty").alias("kind")),
    ]
    union = lambda parts: reduce(DataFrame.unionByName, parts).distinct()
    return union(ids), union(edges)


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """what ('vertex' or 'edge'), kind, n."""
    return vertices.groupBy("kind").count().select(F.lit("vertex").alias("what"), "kind", F.col("count").alias("n")).unionByName(edges.groupBy("kind").count().select(F.lit("edge").alias("what"), "kind", F.col("count").alias("n")))


def pruned(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The vertices that some edge touches; one pass."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return vertices.join(ends, "id", "left_semi")


def director_overlap(companies, company_boards, donor_boards, donations) -> DataFrame:
    """scrip_code, din, donor, n_donations, total_amount, donated, total_seats: directors of a company who sit with a donor other than the company itself.

    donated is the list of the donor's donations (id, amount); total_seats counts all of the director's boards.
    """
    given = donations.groupBy("donor").agg(F.count("id").alias("n_donations"), F.sum("amount").alias("total_amount"), F.array_sort(F.collect_list(F.struct("id", "amount"))).alias("donated"))
    seats = board_seats(company_boards, donor_boards).withColumnRenamed("seats", "total_seats")
    return company_boards.join(companies.select("scrip_code"), "scrip_code").join(donor_boards, "din").filter(F.col("donor").cast("string") != F.col("scrip_code")).join(given, "donor").join(seats, "din").select("scrip_code", "din", "donor", "n_donations", F.round("total_amount", 2).alias("total_amount"), "donated", "total_seats")
