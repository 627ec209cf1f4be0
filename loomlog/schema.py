"""Schemas of the store's tables. Columns are never null; an absent error is ''."""

from __future__ import annotations

#: As read from the store: the folders' names are the last two columns.
MESSAGE = "offset bigint, key string, value binary, timestamp timestamp, topic string, partition int"
TOPIC_EVENT = "topic string, partition int, live boolean, version bigint"
#: Where the next message of a partition goes; the row of the largest version counts.
NEXT = "topic string, partition int, next_offset bigint, version bigint"
#: A row without a topic deletes what its group had committed by then.
COMMIT = "consumer_group string, topic string, partition int, offset bigint, commit_seq bigint"

#: What an auto-created topic gets, and what a reader gets that names no number.
AUTO_PARTITIONS, AUTO_MESSAGES = 4, 100
