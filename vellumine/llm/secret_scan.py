"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are assignments to telling names, access keys, long hex strings, and long mixed
tokens. Their values are hashed and counted over the whole corpus: in how many repositories
and by how many owners each is held. A value that many owners hold, or that one owner holds
in many repositories, is a widely copied example; one that few hold, and that has the variety
of a generated value, looks live. Tokens become spans
only when they look live; the spans of the other kinds always stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import stored
from vellumine.llm.spans import Kind, listed, placed, scanned

#: Patterns (fixed values); the minimal lengths of access and hex are written into them.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    Kind("access", r"AKIA[A-Z0-9]{14,}"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{16,}"),
    Kind("token", r"(?<![A-Za-z0-9+/_-])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}"),
)
NAMES = tuple(k.name for k in KINDS)
BASE = 3  # the first kinds are reported whatever their frequency
ASSIGNED = 12
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 10  # repositories of one owner
VARIETY = 6  # different characters of a value that looks live


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source",
                 example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base, spans, n_live, n_example,
    most_owners, most_repos.

    base and spans are texts of kind:start:end (code points, end exclusive) by start, then
    kind, comma-joined; base leaves the tokens out. n_example counts spans whose value at least
    ``example_owners`` owners hold, or one owner in at least ``example_repos`` repositories;
    n_live those of other values that are varied. most_owners and most_repos are the most owners
    of a value of the row, and the most repositories in which one owner holds one, tokens that
    are no spans included (0 without values). A null text has no spans. A null repository or owner counts as one of its own.
    Repeated rows are scanned each by itself, their values count once per repository. An
    empty table gives no rows.
    """
    scan = scanned(docs, text_col, KINDS, {"id": F.col(f"`{id_col}`"), "repo": F.col(f"`{repo_col}`").cast("string"), "owner": F.col(f"`{owner_col}`").cast("string")})
    spans = placed(scan, "repo", "owner").where((F.col("rank") > 0) | (F.length("value") >= ASSIGNED))
    spans = stored(spans.select("rid", "repo", "owner", "rank", "start", "end", F.sha2("value", 256).alias("hash"),
                                (F.size(F.array_distinct(F.split("value", ""))) >= VARIETY).alias("varied")), "spans")
    holders = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = holders.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    held = stored(owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.max("repos").alias("repos")), "held")
    example = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    told = spans.join(held.hint("merge"), "hash").select(
        "rid", "rank", "start", "end", "owners", "repos", example.alias("example"), (~example & F.col("varied")).alias("live"))
    shown = (F.col("rank") < BASE) | F.col("live")
    per_row = told.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.when(shown, F.struct("start", "rank", "end")))).alias("all"), F.count_if("live").alias("n_live"), F.count_if(shown & F.col("example")).alias("n_example"),
        F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"), *[F.count_if(F.col("rank") == i).alias(f"n_{NAMES[i]}") for i in range(BASE)])
    out = scan.select("rid", "id").join(stored(per_row, "rows").hint("merge"), "rid", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    every = F.coalesce("all", none)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), *[number(f"n_{n}") for n in NAMES[:BASE]], listed(F.filter(every, lambda s: s["rank"] < BASE), NAMES).alias("base"),
                      listed(every, NAMES).alias("spans"), number("n_live"), number("n_example"), number("most_owners"), number("most_repos"))
