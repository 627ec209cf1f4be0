"""Column functions: hashes, routes, codecs and names."""

from .codec import decode_offset, encode_offset, message_key, offset_key, persisted_json, read_persisted_json
from .hashing import fnv1a32, fnv_partition, message_bytes, sha1_prefix
from .names import consumer_state, group_state, throughput_verdict

__all__ = ["consumer_state", "decode_offset", "encode_offset", "fnv1a32", "fnv_partition", "group_state", "message_bytes", "message_key", "offset_key", "persisted_json", "read_persisted_json", "sha1_prefix", "throughput_verdict"]
