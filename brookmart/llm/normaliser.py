"""The normaliser of a SentencePiece model, compiled from the model's own character map.

The map is a trie over bytes, kept as one array of units, whose leaves point into a list of replacements. It is compiled
into a transducer over characters: at each place the longest rule that fits is applied, any other character is put out
as it is. After it comes a second machine that drops spaces at both ends and behind a space, if the model says so.
"""

from __future__ import annotations

import re
import struct

import numpy as np


def rules(charsmap: bytes) -> dict[str, str]:
    """What the map replaces by what. Units of the array: bit 8 tells a leaf, the lower byte is the label, the rest the
    offset, shifted by a byte if bit 9 is set; a leaf's value is the place of its replacement, which ends with a zero."""
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units, texts = np.frombuffer(charsmap, "<u4", size // 4, 4), charsmap[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    labels, found = np.arange(1, 256), {}
    todo = [(b"", offset(int(units[0])))]
    while todo:
        key, base = todo.pop()
        places = base ^ labels
        inside = places < len(units)
        here = np.zeros(len(labels), np.uint32)
        here[inside] = units[places[inside]]
        for c in labels[inside & ((here & 0x800000FF) == labels)].tolist():
            unit = int(units[base ^ c])
            below = (base ^ c) ^ offset(unit)
            longer = key + bytes([c])
            if unit >> 8 & 1:
                at = int(units[below]) & 0x7FFFFFFF
                found[longer.decode()] = texts[at : texts.index(b"\0", at)].decode()
            todo.append((longer, below))
    return found


class Normaliser:
    def __init__(self, charsmap: bytes, tidy: bool):
        """`tidy` drops spaces at both ends and behind a space."""
        self.rules, self.tidy = rules(charsmap), tidy
        if any("  " in v for v in self.rules.values()):
            raise ValueError("a rule puts out two spaces")
        sizes: dict[str, set[int]] = {}
        for k in self.rules:
            sizes.setdefault(k[0], set()).add(len(k))
        self.sizes = {c: sorted(n, reverse=True) for c, n in sizes.items()}
        self.first = re.compile("[" + "".join(map(re.escape, self.sizes)) + "]") if sizes else None

    def __call__(self, text: str) -> str:
        if self.first and self.first.search(text):
            out, done = [], 0
            for m in self.first.finditer(text):
                at = m.start()
                if at < done:
                    continue
                n = next((n for n in self.sizes[m[0]] if text[at : at + n] in self.rules), 0)
                if n:
                    out += [text[done:at], self.rules[text[at : at + n]]]
                    done = at + n
            text = "".join([*out, text[done:]])
        if self.tidy:
            text = re.sub(" {2,}", " ", text.lstrip(" ")).rstrip(" ▁")
        return text
