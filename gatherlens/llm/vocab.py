"""Public tokenizers inside tasks: files are read once on the driver and shipped, texts
are cut where the tokenizer cuts them too, and each distinct piece is encoded once."""
from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a task remembers.
CACHED_PIECES = 1 << 19
_LOADED: dict = {}


class Source(NamedTuple):
    """Content of a tokenizer's file, and what kind it is."""
    kind: str
    data: bytes

    def key(self) -> tuple:
        return self.kind, hashlib.blake2b(self.data, digest_size=16).digest()


def public(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def read(path: str) -> Source:
    """A ``tokenizers`` JSON file or a SentencePiece model."""
    with open(path, "rb") as f:
        return Source("json" if path.endswith(".json") else "piece", f.read())


def loaded(source: Source):
    """The tokenizer of a file; once per worker."""
    key = source.key()
    if key not in _LOADED:
        if source.kind == "json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer
            _LOADED[key] = Tokenizer.from_str(source.data.decode("utf-8"))
        else:
            import sentencepiece
            _LOADED[key] = sentencepiece.SentencePieceProcessor(model_proto=source.data)
    return _LOADED[key]


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable bytes
    as they are, the others as the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def token_bytes(source: Source) -> list[bytes]:
    """The bytes that each id stands for."""
    t = loaded(source)
    if source.kind == "json":
        alphabet, out = byte_alphabet(), [b""] * t.get_vocab_size(with_added_tokens=True)
        added = {a["id"] for a in json.loads(source.data)["added_tokens"]}
        for token, i in t.get_vocab(with_added_tokens=True).items():
            out[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        return out
    out = []
    for i in range(t.get_piece_size()):
        piece = t.id_to_piece(i)
        if t.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif t.is_control(i) or t.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


# Cuts that both kinds make.  Before a blank that follows another character than white
# space: no match of byte-level pre-tokenization goes on into white space, and no piece over
# a blank.  Before a mark that follows a letter and ends the word: a match of letters ends
# there, and no piece has both.
_EDGE = re.compile(r"(?<=[!-~À-ɏ])(?= )")
_OTHER_EDGE = re.compile(r"[^!-~À-ɏ] |\x00")
MARKS = (".", ",")


def cut(texts: list[bytes]) -> pa.ListArray:
    """The pieces of blank + text, for many texts; none for empty texts."""
    column = pa.array([b" " + t for t in texts], pa.binary())
    column = pc.replace_substring_regex(column, r"([A-Za-z])([.,])( |$)", "\\1\x00\\2\\3")
    parts = pc.split_pattern(pc.replace_substring(column, b" ", b"\x00 "), b"\x00")
    offsets, flat = parts.offsets.to_numpy(), parts.flatten()
    # The part before the first blank is empty.
    keep = np.ones(len(flat), bool)
    keep[offsets[:-1]] = False
    lists = pa.ListArray.from_arrays(pa.array(offsets - np.arange(len(offsets)), pa.int32()), flat.filter(pa.array(keep)))
    decoded = [t.decode("utf-8", "replace") for t in texts]
    odd = [i for i, t in enumerate(decoded) if not t or _OTHER_EDGE.search(" " + t)]
    if not odd:
        return lists
    own = pa.array([[p.encode() for p in _EDGE.split(" " + decoded[i])] if decoded[i] else [] for i in odd], pa.list_(pa.binary()))
    order = np.arange(len(texts))
    order[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([lists, own]).take(pa.array(order))


def can_cut(source: Source) -> bool:
    """Whether encoding the pieces one by one gives the ids of the whole."""
    if source.kind == "json":
        j = json.loads(source.data)
        pre = j["pre_tokenizer"] or {}
        return not j["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    t = loaded(source)
    return (all(not t.is_unknown(t.piece_to_id(m)) for m in MARKS)
            and not any(re.search("[^▁]▁|[A-Za-z][.,]", t.id_to_piece(i)) for i in range(t.get_piece_size())))


class Pieces:
    """Ids of lists of pieces (Arrow, binary).  The pieces of a chunk are numbered by Arrow;
    ``make`` gets the new ones of its distinct pieces and gives the ids (u32) of each, under
    one tokenizer or more.  Pieces that were not met for a while are forgotten."""

    def __init__(self, make, most: int = CACHED_PIECES):
        self.make, self.most, self.known, self.older = make, most, {}, {}

    def of(self, pieces: list[str]) -> list:
        """What ``make`` gives for each of some distinct pieces."""
        if len(self.known) > self.most // 2:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, pieces))
        at = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in at:
            x = found[i] = self.older.get(pieces[i])
            if x is None:
                new.append(i)
        for i, x in zip(new, self.make([pieces[i] for i in new]) if new else ()):
            found[i] = x
        self.known.update((pieces[i], found[i]) for i in at)
        return found

    def ids(self, lists: pa.ListArray, tokenizers: int = 1):
        """For each tokenizer: the ids of all pieces in order, and how many there are up to
        each piece's end.  And the number of pieces up to each list's end."""
        numbered = lists.flatten().dictionary_encode()
        found = self.of([p.decode("utf-8", "replace") for p in numbered.dictionary.to_pylist()])
        index = numbered.indices.to_numpy(zero_copy_only=False)
        gathered = [self._gather([f[k] for f in found] if tokenizers > 1 else found, index) for k in range(tokenizers)]
        return gathered, lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()

    @staticmethod
    def _gather(found: list[bytes], index: np.ndarray):
        sizes = np.array([len(f) for f in found], np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        own = sizes[index]
        total = np.cumsum(own)
        place = np.repeat(starts[index] - (total - own), own) + np.arange(total[-1] if len(total) else 0)
        return np.frombuffer(b"".join(found), np.uint32)[place], np.concatenate([[0], total])


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


TOGETHER = 50


def encode_together(t, pieces: list[str], between: str, first: np.ndarray | None, last: np.ndarray | None) -> list[bytes]:
    """Ids (u32) of each of the pieces, encoding TOGETHER of them at a time, which takes
    half the time.  Only the first id of a piece (or only its last) is one of those flagged."""
    some = [pieces[i:i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
    out = []
    for ps, e in zip(some, t.encode_batch_fast([between.join(ps) for ps in some], add_special_tokens=False)):
        ids = np.array(e.ids, np.uint32)
        cuts = np.flatnonzero(first[ids]) if first is not None else np.flatnonzero(last[ids]) + 1
        cuts = np.append(cuts, len(ids)) if first is not None else np.append(0, cuts)
        if len(cuts) != len(ps) + 1 or cuts[0] or cuts[-1] != len(ids):
            out += [packed(e.ids) for e in t.encode_batch_fast(ps, add_special_tokens=False)]
            continue
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        out += [raw[a:z] for a, z in zip(cuts, cuts[1:])]
    return out
