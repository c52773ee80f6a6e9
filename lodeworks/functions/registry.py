"""Tokenizers by name and revision, and what shards and artifacts say about the one they were made with.

A registry is a folder: ``{root}/{name}/{revision}/tokenizer.json``.  A tokenizer that is opened from it is
sent to all workers under its digest, so they need no access to the folder, and each worker makes sure that
what it opens is that file.  A fingerprint tells tokenizers apart whatever they are called: two revisions with
one file have the same, one name whose file has changed has another.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath

from pyarrow import fs as pafs
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from .tokenizers import FileTokenizer, Tokenizer

#: The file beside shards that names their tokenizer; it does not end in .bin, so no reader takes it for one.
MANIFEST = "_tokenizer.json"


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fingerprint(tokenizer: Tokenizer) -> str:
    """The digest of a tokenizer's file, or the name of a built-in one with its vocabulary's size; and the
    special ids that go into shards."""
    own = _digest(tokenizer.located()) if isinstance(tokenizer, FileTokenizer) else f"{type(tokenizer).__name__}/{tokenizer.vocab_size}"
    return f"{own}:{tokenizer.bos_token_id}:{tokenizer.eos_token_id}"


class NamedTokenizer(FileTokenizer):
    """A registry's tokenizer on the workers of a session."""

    def __init__(self, spark: SparkSession, root: str, name: str, revision: str = "main", bos_token_id: int | None = None, eos_token_id: int | None = None):
        folder = os.path.join(root, name, revision)
        path = os.path.join(folder, "tokenizer.json")
        if not os.path.isfile(path):
            known = sorted(os.listdir(os.path.join(root, name))) if os.path.isdir(os.path.join(root, name)) else []
            raise FileNotFoundError(f"no tokenizer {name}@{revision} below {root}; revisions: {', '.join(known) or 'none'}")
        self.name, self.revision, self.digest = name, revision, _digest(path)
        # files are sent under their own names, so the copy is named by the digest
        sent = os.path.join(folder, f"{self.digest}.json")
        if not os.path.exists(sent):
            sent = _copied(path, self.digest)
        spark.sparkContext.addFile(sent)
        super().__init__(f"{self.digest}.json", bos_token_id, eos_token_id)

    def located(self) -> str:
        return _located(self.path)

    @staticmethod
    def _file(path: str):
        return FileTokenizer._file(_located(path))


def _copied(path: str, digest: str) -> str:
    import shutil
    import tempfile

    return shutil.copyfile(path, os.path.join(tempfile.mkdtemp(prefix="lodeworks-tokenizer-"), f"{digest}.json"))


_checked: set[str] = set()


def _located(name: str) -> str:
    """Where a sent file is on this machine; its bytes must be those that it is named by."""
    path = SparkFiles.get(name)
    if path not in _checked:
        if f"{_digest(path)}.json" != name:
            raise ValueError(f"{path} is not the file that was sent")
        _checked.add(path)
    return path


def _place(root: str) -> tuple[pafs.FileSystem, str]:
    files, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    return files, posixpath.join(base, MANIFEST)


def write_manifest(root: str, tokenizer: Tokenizer) -> None:
    """Say beside shards what they were made with."""
    said = {"fingerprint": fingerprint(tokenizer), "vocab_size": tokenizer.vocab_size, "eos_token_id": tokenizer.eos_token_id}
    if isinstance(tokenizer, NamedTokenizer):
        said |= {"name": tokenizer.name, "revision": tokenizer.revision}
    _put(root, said)


def _put(root: str, said: dict) -> None:
    files, at = _place(root)
    files.create_dir(posixpath.dirname(at), recursive=True)
    with files.open_output_stream(at) as f:
        f.write(json.dumps(said, indent=2).encode())


def read_manifest(root: str) -> dict | None:
    """What the shards of a folder were made with; None if they do not say."""
    files, at = _place(root)
    if files.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with files.open_input_file(at) as f:
        return json.loads(f.read())


def copy_manifest(root: str, output: str) -> None:
    if said := read_manifest(root):
        _put(output, said)
