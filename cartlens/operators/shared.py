"""Blocks that many reports have in common, computed once per batch of reports."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame

from cartlens.session import delete, shared_folder, store


class SharedSales:
    """Sales rows for a batch of reports.

    Pass it where a report takes `sales`. Every block below is then computed
    at its first use, from the sales rows or from another block, stored as Parquet, and
    read back column by column afterwards, so a full set of reports scans the fact
    table a handful of times. `close`, or the end of a with statement, deletes the blocks; frames that
    start from them can then no longer be computed.
    """

    def __init__(self, sales: DataFrame):
        self.sales = sales
        self._blocks: dict = {}
        self._folders: list[str] = []

    def block(self, build, p, *args) -> DataFrame:
        key = (build.__name__, p, args)
        if key not in self._blocks:
            self._blocks[key] = self.stored(build(self, p, *args))
        return self._blocks[key]

    def stored(self, block: DataFrame) -> DataFrame:
        self._folders.append(f"{shared_folder(block.sparkSession)}/block-{uuid.uuid4().hex}")
        return store(block, self._folders[-1])

    def close(self) -> None:
        while self._folders:
            delete(self.sales.sparkSession, self._folders.pop())
        self._blocks.clear()

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()


def shared(build):
    """Let a block that takes (sales, p, ...) also work on SharedSales."""

    @wraps(build)
    def run(sales, p, *args):
        if isinstance(sales, SharedSales):
            return sales.block(build, p, *args)
        return build(sales, p, *args)

    return run
