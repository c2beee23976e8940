"""Envelopes as bytes: a JSON object by field name. A reader skips fields that it does not know and takes
defaults for those that are missing; a newer version and anything behind the object are refused. An
envelope holds one page, so its size has the page's bounds."""

from __future__ import annotations

import base64
import json

from ..functions.versions import FIELDS
from .sync import Envelope, Page

VERSION = 1


class CodecError(ValueError):
    pass


def _b64(raw) -> str | None:
    return None if raw is None else base64.b64encode(bytes(raw)).decode()


def _raw(text: str | None) -> bytes | None:
    return None if text is None else base64.b64decode(text, validate=True)


def encode(e: Envelope) -> bytes:
    rows = [{c: _b64(x) if c == "value" else x for c, x in zip(FIELDS, r, strict=True)} for r in e.rows()]  # one page
    out = {"version": e.version, "sender_id": e.sender, "sender_uuid": _b64(e.uuid), "acks": {str(k): v for k, v in e.acks.items()}, "entries": rows}
    out |= {"digest": e.digest, "cursor": e.cursor, "reset_acks": e.reset_acks, "push_only": e.push_only}
    return json.dumps({k: v for k, v in out.items() if v is not None}, ensure_ascii=False).encode()


def decode(spark, data: bytes) -> Envelope:
    try:
        d = json.loads(data)
        rows = [(r["key"], _raw(r.get("value")), r["node"], r["seq"], r["timestamp"]) for r in d["entries"]]
        acks = {int(k): int(v) for k, v in d["acks"].items()}
        cursor = tuple(d["cursor"]) if d.get("cursor") is not None else None
        sender, uuid, version = int(d["sender_id"]), _raw(d["sender_uuid"]) or b"", int(d["version"])
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise CodecError(f"no envelope: {e}") from e
    if version > VERSION:
        raise CodecError(f"version {version} is newer than {VERSION}")
    entries = Page(spark, [(k, None if v is None else bytearray(v), n, s, t) for k, v, n, s, t in rows])
    return Envelope(sender, uuid, acks, entries, d.get("digest"), cursor, bool(d.get("reset_acks", False)), bool(d.get("push_only", False)), version)
