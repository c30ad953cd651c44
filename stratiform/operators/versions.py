"""Versioned datasets: history, time travel, rollback and audit before publishing.

A dataset is a folder of Parquet parts, one per commit that wrote data, and a log with one
small file per commit. A version names the parts it is made of, so reading it touches no
other part. Commits are expected from one writer at a time; a second one that takes the
same version number fails when it writes the log entry. What a commit left that failed half
way, a part without its entry or an entry that was never finished, is not read and is no
hindrance to the next commit.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.operators.headers import union_all
from stratiform.operators.quality import ALERT
from stratiform.session import checkpointed

LOG = (
    "version bigint, parent bigint, branch string, committed_at timestamp, operation string, "
    "n_rows bigint, parts array<bigint>, columns string"
)

Check = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Commit:
    version: int
    parent: int | None
    branch: str
    committed_at: datetime
    operation: str
    n_rows: int
    parts: list[int]
    columns: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)


def _widen(old: T.StructType, new: T.StructType) -> T.StructType:
    """Old columns, then the new ones; a column may not change its type."""
    known = {field.name: field.dataType for field in old}
    for field in new:
        if known.get(field.name, field.dataType) != field.dataType:
            raise ValueError(f"column {field.name} changes from {known[field.name]} to {field.dataType}")
    return T.StructType([*old, *[field for field in new if field.name not in known]])


class VersionedDataset:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # -- log ---------------------------------------------------------------------------

    def _part(self, number: int) -> str:
        return f"{self.path}/data/_version={number}"

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log/*")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def commits(self) -> list[Commit]:
        """All commits, oldest first: metadata, one entry per commit."""
        entries = [Commit(**row.asDict()) for row in self.log().collect()]
        return sorted(entries, key=lambda commit: commit.version)

    def _append(self, commit: Commit) -> Commit:
        kinds = dict(part.strip().split(" ", 1) for part in LOG.split(", "))
        values = [F.lit(value).cast(kinds[name]).alias(name) for name, value in asdict(commit).items()]
        entry = self.spark.range(0, 1, 1, 1).select(*values)
        folder = f"{self.path}/log/{commit.version:012d}"
        try:
            entry.write.mode("error").parquet(folder)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_ALREADY_EXISTS" or any(c.version == commit.version for c in self.commits()):
                raise
            entry.write.mode("overwrite").parquet(folder)  # an entry that was never finished
        return commit

    def _write_part(self, df: DataFrame, number: int) -> int:
        """Writes a part under the version's number, or under a random one where a failed commit left that folder."""
        try:
            df.write.mode("error").parquet(self._part(number))  # a late writer never replaces a part
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number = random.SystemRandom().getrandbits(62)
            df.write.mode("error").parquet(self._part(number))
        return number

    def history(self) -> DataFrame:
        return self.log().select("version", "parent", "branch", "committed_at", "operation", "n_rows")

    def branches(self, commits: Sequence[Commit] | None = None) -> dict[str, Commit]:
        """Branches in use and their last commit."""
        heads = {commit.branch: commit for commit in (self.commits() if commits is None else commits)}
        return {name: head for name, head in heads.items() if head.operation != "drop_branch"}

    def head(self, branch: str = "main", commits: Sequence[Commit] | None = None) -> Commit:
        heads = self.branches(commits)
        if branch not in heads:
            raise ValueError(f"no branch {branch}")
        return heads[branch]

    def _commit_of(self, version: int, commits: Sequence[Commit] | None = None) -> Commit:
        known = self.commits() if commits is None else commits
        found = next((commit for commit in known if commit.version == version), None)
        if found is None:
            raise ValueError(f"no version {version}")
        return found

    def _point(
        self, commits: Sequence[Commit], target: Commit, branch: str, operation: str, at: datetime | None, parent: int
    ) -> Commit:
        """A commit that writes no data: the branch now shows the target's parts."""
        return self._append(
            Commit(
                commits[-1].version + 1,
                parent,
                branch,
                at or datetime.now(timezone.utc),
                operation,
                target.n_rows,
                target.parts,
                target.columns,
            )
        )

    # -- writing -----------------------------------------------------------------------

    def commit(
        self, df: DataFrame, mode: str = "append", branch: str = "main", at: datetime | None = None
    ) -> Commit:
        """Write ``df`` as a new part. ``append`` may add columns: older rows read as null."""
        if mode not in ("append", "overwrite"):
            raise ValueError(f"unknown mode {mode}")
        commits = self.commits()
        head = self.branches(commits).get(branch)
        if head is None and branch != "main":
            raise ValueError(f"no branch {branch}")
        number = commits[-1].version + 1 if commits else 1
        before = head if mode == "append" else None
        schema = _widen(before.schema, df.schema) if before else df.schema
        part = self._write_part(df, number)
        written = self.spark.read.schema(df.schema).parquet(self._part(part)).count()  # from the footers
        return self._append(
            Commit(
                number,
                head.version if head else None,
                branch,
                at or datetime.now(timezone.utc),
                mode,
                written + (before.n_rows if before else 0),
                [*(before.parts if before else []), part],
                _ddl(schema),
            )
        )

    def rollback(self, version: int, branch: str = "main", at: datetime | None = None) -> Commit:
        commits = self.commits()
        target = self._commit_of(version, commits)
        return self._point(commits, target, branch, "rollback", at, self.head(branch, commits).version)

    def create_branch(self, name: str, source: str = "main", at: datetime | None = None) -> Commit:
        commits = self.commits()
        heads = self.branches(commits)
        if name in heads:
            return heads[name]
        base = self.head(source, commits)
        return self._point(commits, base, name, "create_branch", at, base.version)

    def drop_branch(self, name: str, at: datetime | None = None) -> Commit:
        commits = self.commits()
        head = self.head(name, commits)
        return self._point(commits, head, name, "drop_branch", at, head.version)

    def merge(self, branch: str, into: str = "main", at: datetime | None = None) -> Commit:
        """Show the branch's version on ``into``, unless ``into`` moved on since the branch began."""
        commits = self.commits()
        source, target = self.head(branch, commits), self.head(into, commits)
        base = [c for c in commits if c.branch == branch and c.operation == "create_branch"][-1].parent
        if target.version != base:
            raise ValueError(f"{into} has new commits since {branch} was created")
        return self._point(commits, source, into, "merge", at, target.version)

    def publish(
        self, branch: str, checks: Sequence[Check], into: str = "main", at: datetime | None = None
    ) -> tuple[bool, DataFrame | None]:
        """Merge and drop the branch if no check reports an alert; returns the reports."""
        audited = self.read(branch)
        reports = [check(audited).select(F.to_json(F.struct("*")).alias("resultat"), "statut") for check in checks]
        report = checkpointed(union_all(reports)) if reports else None
        if report is not None and not report.filter(F.col("statut") == ALERT).isEmpty():
            return False, report
        self.merge(branch, into, at)
        self.drop_branch(branch, at)
        return True, report

    # -- reading -----------------------------------------------------------------------

    def _parts(self, commit: Commit, parts: Sequence[int]) -> DataFrame:
        schema = commit.schema
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._part(number) for number in parts])

    def read(self, branch: str = "main") -> DataFrame:
        head = self.head(branch)
        return self._parts(head, head.parts)

    def as_of_version(self, version: int) -> DataFrame:
        commit = self._commit_of(version)
        return self._parts(commit, commit.parts)

    def as_of_timestamp(self, at: datetime, branch: str = "main") -> DataFrame:
        """The last version of the branch committed at or before a time."""
        row = (
            self.log()
            .filter((F.col("branch") == branch) & (F.col("committed_at") <= F.lit(at)))
            .agg(F.max("version").alias("v"))
            .first()
        )
        if row.v is None:
            raise ValueError(f"{branch} has no version at {at}")
        return self.as_of_version(row.v)

    def diff(self, old: int, new: int) -> DataFrame:
        """Rows with the number of copies added or removed between two versions.

        Parts that both versions share cancel out and are not read.
        """
        commits = self.commits()
        a, b = self._commit_of(old, commits), self._commit_of(new, commits)
        shared = set(a.parts) & set(b.parts)
        sides = [
            self._parts(commit, [n for n in commit.parts if n not in shared]).withColumn("_n", F.lit(sign))
            for commit, sign in ((a, -1), (b, 1))
        ]
        rows = union_all(sides)
        keys = [F.col(f"`{name}`") for name in rows.columns if name != "_n"]
        changed = rows.groupBy(*keys).agg(F.sum("_n").alias("_n")).filter("_n != 0")
        kind = F.when(F.col("_n") > 0, "AJOUTE").otherwise("SUPPRIME")
        return changed.withColumns({"changement": kind, "nb": F.abs("_n")}).drop("_n")

    def retained(self, cutoff: datetime) -> DataFrame:
        """History limited to commits since ``cutoff``; the last one of each branch always stays."""
        heads = [head.version for head in self.branches().values()]
        return self.history().filter((F.col("committed_at") >= F.lit(cutoff)) | F.col("version").isin(heads))
