"""Repositories as a data source, read on the executors through a RepoSource, in pages of files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrysift.sources.providers import FolderRepos, RepoSource

#: A page has about so many files and bytes at most, so that a large repository is read by many tasks.
PAGE_FILES, PAGE_BYTES = 2000, 64 * 2**20


class Page(InputPartition):
    def __init__(self, repo: str, paths: list[str]):
        self.repo, self.paths = repo, paths


def pages(repo: str, listed: list[tuple[str, int]], most: int | None) -> Iterator[Page]:
    """A repository's files breadth first (those of upper folders come before those further down), `most` of them, cut into pages."""
    paths, size = [], 0
    for path, n in sorted(listed, key=lambda f: (f[0].count("/"), f[0]))[:most]:
        if paths and (len(paths) == PAGE_FILES or size + n > PAGE_BYTES):
            yield Page(repo, paths)
            paths, size = [], 0
        paths.append(path)
        size += n
    if paths:
        yield Page(repo, paths)


class _Reader(DataSourceReader):
    def __init__(self, source: RepoSource, repos: list[str], most: int | None):
        self.source, self.repos, self.most = source, repos, most

    def partitions(self) -> list[InputPartition]:
        found = [p for r in self.repos for p in pages(r, self.source.list(r), self.most)]
        return found or [Page("", [])]

    def read(self, partition: Page) -> Iterator[tuple]:
        for path in partition.paths:
            text = self.source.read(partition.repo, path)
            yield partition.repo, path, path.rsplit("/", 1)[-1], len(text.encode()), text


class RepoFiles(DataSource):
    """spark.read.format("repo_files").option("root", ...).option("repos", "a,b").load()

    root is a folder that all executors share, by URI. The option max_files is a quota for each repository; without it all
    files are read. Only names and sizes are listed on the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "repo string, file_path string, file_name string, size_bytes long, code string"

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("max_files")
        return _Reader(FolderRepos(self.options["root"]), [r for r in self.options["repos"].split(",") if r], int(most) if most else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepoFiles)
