"""Change sets from git: a row for each changed file, with its text before and after, that executors read (`git_source`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources import git_source
from ledgerline.sources.files import MAX_BLOB

CHANGE_SET = git_source.CHANGES


def worktree_changes(spark: SparkSession, repository: str, staged: bool = False, most: int = MAX_BLOB) -> DataFrame:
    """Changes against the last commit: of the index (staged), or of the files as they are, new ones included. Text over the limit is left out."""
    return git_source.changes(spark, repository, "HEAD", git_source.INDEX if staged else git_source.WORKTREE, most)


def revision_changes(spark: SparkSession, repository: str, revision: str, most: int = MAX_BLOB) -> DataFrame:
    """Changes of one commit against its first parent; all of a first commit's files are added."""
    return git_source.changes(spark, repository, ":parent", revision, most)
