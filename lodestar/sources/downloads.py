"""Downloads that can be run again: whole files by rename, checked by the digest of what is inside."""

from __future__ import annotations

import hashlib
import io
import json
import os
import urllib.request
import zipfile
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

Fetch = Callable[[str], bytes]


def fetch_url(url: str, timeout: float = 60) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def inner_sha256(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return hashlib.sha256(archive.read(archive.namelist()[0])).hexdigest()


def saved(path: Path, content: bytes) -> None:
    """Under another name first, so that a file that is there is whole."""
    part = path.with_suffix(path.suffix + ".part")
    part.write_bytes(content)
    os.replace(part, path)


def download(url: str, path: Path, sha256: str | None = None, fetch: Fetch = fetch_url, digest: Callable[[bytes], str] = inner_sha256) -> str:
    """``present``, ``downloaded`` or raises; a file with the wrong digest is fetched again."""
    if path.exists() and (sha256 is None or digest(path.read_bytes()) == sha256):
        return "present"
    content = fetch(url)
    if sha256 is not None and digest(content) != sha256:
        raise ValueError(f"{url}: the content's digest is not {sha256}")
    path.parent.mkdir(parents=True, exist_ok=True)
    saved(path, content)
    return "downloaded"


def sync_documents(catalogue: Iterable[Mapping[str, str]], folder: Path, fetch: Fetch = fetch_url) -> list[dict]:
    """Every document of the catalogue (id, url) in ``folder``, and the manifest of exactly these."""
    folder.mkdir(parents=True, exist_ok=True)
    rows = []
    for item in catalogue:
        path = folder / f"{item['id']}.pdf"
        state = download(item["url"], path, fetch=fetch)
        content = path.read_bytes()
        rows.append({"id": item["id"], "url": item["url"], "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "state": state})
    rows.sort(key=lambda r: r["id"])
    saved(folder / "manifest.json", json.dumps(rows, ensure_ascii=False, indent=1).encode())
    return rows
