"""Problem 10: text decoded with a wrong character encoding, found and restored.

A code-page swap is treated as a substitution cipher. Its symbols are the characters of a garbled word, or the runs
of two to four characters that one UTF-8 letter became; its plain text is what the languages' bigrams expect.

1. Suspicious words: every word's character pairs are scored with the bigrams of all labelled samples, whole batches
   at once as arrays of code points. A word with a pair of unlike characters, or with unlikely pairs throughout, is
   suspicious; neighbouring suspicious words form a run. Only runs go on, texts are read once and not shuffled.
2. Per source, the symbols' neighbours in suspicious words are counted over all documents (a distributed aggregation
   whose groups are bounded by the square of the symbol set).
3. Expectation-maximization on those counts learns, for each source, a mixture of ciphers: which letter of the
   languages' alphabets each symbol stands for. The readings of known code-page swaps are a prior, which counts
   overrule; a cipher without any prior is learnt from what no known swap explains, and kept only where its
   plain text reads like a language.
4. The learnt tables are applied to each run with translate(); a run is garbled if a mapped form is clearly likelier
   than what stands there. Replacement characters are always a case: the original is lost.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.lookalikes import pair_counts
from storyloom.session import checkpoint

#: Known swaps, a prior of the ciphers: code pages that UTF-8 is misread in, and (true, read) pairs of single-byte pages.
UTF8_READ_AS = ("latin-1", "cp1252", "cp1256", "cp850", "mac_roman", "cp1251", "cp437", "iso8859-15")
PAGE_SWAPS = (("cp1256", "latin-1"), ("cp1256", "cp1252"), ("iso8859-6", "latin-1"), ("iso8859-6", "cp1252"), ("cp1256", "mac_roman"), ("cp1256", "cp850"))
#: Rounds of expectation-maximization with a prior, and without one.
ROUNDS, FREE_ROUNDS = 20, 60
#: Observations that the reading of a known swap counts for.
PRIOR_WEIGHT = 3.0
#: A reading is overruled by a letter of this probability, from so many observations of the symbol on.
OVERRULE, OVERRULE_SEEN = 0.5, 30
#: A reading that is not overruled keeps such a probability.
LEAST_TRUST = 0.05
#: A cipher without prior needs so many unexplained pairs, a plain text at most so much less likely a pair than the samples, and
#: readings of such a probability on average, for so many symbols.
FREE_SYMBOLS = 6
FREE_PAIRS, FREE_LOSS, FREE_SURE = 400, 1.0, 0.55
#: Natural logarithms by which a mapped run must be likelier than the run itself.
MARGIN = 4.0
#: A word whose pairs are less likely than this on average is suspicious.
UNLIKELY = -6.5
#: Words of more characters are always looked at.
LONG_WORD = 1_000_000
FREE = "free"
_RUNS = "doc_id bigint, source string, text string, runs array<struct<start:int,stop:int,run:string>>"


def page_bytes(page: str) -> dict[str, int]:
    """Character to byte of the upper half of a code page; bytes a Windows page leaves open stand for themselves."""
    table: dict[str, int] = {}
    for byte in range(128, 256):
        try:
            table[bytes([byte]).decode(page)] = byte
        except UnicodeDecodeError:
            if page.startswith("cp125"):
                table[chr(byte)] = byte
    return table


def is_text(ch: str) -> bool:
    """Whether a decoded character may stand in a text; what is garbled twice holds C1 controls in between."""
    return 0x80 <= ord(ch) < 0xA0 or unicodedata.category(ch) not in ("Cc", "Cn", "Co", "Cs")


class Swap:
    """One code-page swap: how to find its symbols in a text and what they stand for."""

    def __init__(self, name: str, true: str, read: str) -> None:
        self.name, self.utf8 = name, true == "utf-8"
        self.letters: dict[str, str | None] = {}
        self.bytes = page_bytes(read)
        if self.utf8:
            chars = lambda lo, hi: "".join(re.escape(c) for c, b in self.bytes.items() if lo <= b < hi)
            tail = f"[{chars(0x80, 0xC0)}]"
            self.find = re.compile(f"[{chars(0xC2, 0xE0)}]{tail}|[{chars(0xE0, 0xF0)}]{tail}{{2}}|[{chars(0xF0, 0xF5)}]{tail}{{3}}")
        else:
            self.map = {}
            for ch, byte in self.bytes.items():
                try:
                    letter = bytes([byte]).decode(true)
                except UnicodeDecodeError:
                    continue
                if letter != ch and is_text(letter):
                    self.map[ch] = letter

    def letter(self, symbol: str) -> str | None:
        """What a symbol stands for by the codecs, or None."""
        if not self.utf8:
            return self.map.get(symbol)
        if symbol not in self.letters:
            try:
                letter = bytes(self.bytes[c] for c in symbol).decode("utf-8")
            except (UnicodeDecodeError, KeyError):
                letter = ""
            # a bounded memory: there are no more symbols than letters of UTF-8
            self.letters[symbol] = letter if len(letter) == 1 and is_text(letter) else None
        return self.letters[symbol]


def all_swaps() -> list[Swap]:
    return [Swap(f"utf-8>{p}", "utf-8", p) for p in UTF8_READ_AS] + [Swap(f"{a}>{b}", a, b) for a, b in PAGE_SWAPS]


def folded(ch: str) -> str:
    """A character as the model counts it: lower case, digits as 0."""
    low = ch.lower()
    return "0" if ch.isdigit() else low if len(low) == 1 else ch


def model_pairs(samples: Iterable[tuple[str, str]]) -> Counter:
    """How often each (model, character, next character) stands in the texts of (language, text); one model, named "", for all
    languages. The blank that ends each text is counted with an empty next character."""
    pairs: Counter = Counter()
    for _, text in samples:
        chars = " " + "".join(map(folded, re.sub(r"\s", " ", text))) + " "
        pairs.update(("", a, b) for a, b in zip(chars, chars[1:]))
        pairs["", " ", ""] += 1
    return pairs


class Model:
    """Character bigrams of the labelled samples; pairs of unlike scripts are far less likely than unseen ones."""

    rare, odd = -9.0, -12.0

    def __init__(self, texts: list[str]) -> None:
        self._fit(sorted((*key, n) for key, n in model_pairs(("", text) for text in texts).items()))

    @classmethod
    def of(cls, counts: list[tuple[str, str, str, int]]) -> Model:
        """The model of counts by model_pairs."""
        model = cls.__new__(cls)
        model._fit(counts)
        return model

    def _fit(self, counts: list[tuple[str, str, str, int]]) -> None:
        pairs, firsts = {(a, b): n for _, a, b, n in counts if b}, Counter()
        for _, a, _, n in counts:
            firsts[a] += n
        self.count = firsts
        self.known = frozenset(firsts)
        self.value = {p: max(self.rare, math.log(n / firsts[p[0]])) for p, n in pairs.items()}
        total = sum(pairs.values())
        #: What a pair of ordinary text is worth on average.
        self.usual = sum(n * self.value[p] for p, n in pairs.items()) / total if total else self.rare

    def pair(self, a: str, b: str) -> float:
        x = self.value.get((a, b))
        return x if x is not None else (self.rare if a in self.known and b in self.known else self.odd)

    def scorer(self) -> Callable[[str], float]:
        """A function from a text to the logarithm of its likelihood, a blank at both ends."""
        import numpy as np

        letters = sorted(self.known)
        n = len(letters)
        ids = {ch: i for i, ch in enumerate(letters)}
        table = np.full(0x110000, n, dtype=np.int32)
        for ch, i in ids.items():
            table[[ord(c) for c in {ch, ch.upper()} if len(c) == 1 and folded(c) == ch]] = i
        table[[code for code in range(0x20000) if chr(code).isdigit()]] = ids.get("0", n)
        value = np.array([[self.pair(a, b) for b in letters] + [self.odd] for a in letters] + [[self.odd] * (n + 1)], dtype=np.float64).reshape(-1)

        def score(text: str) -> float:
            at = table[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            return float(value[at[:-1] * (n + 1) + at[1:]].sum())

        return score


def make_suspects(model: Model) -> Callable[[list[str]], list[list[tuple[int, int]]]]:
    """A function from texts to the places (start, stop) of their suspicious runs."""
    import numpy as np

    # classes of characters: 0 blank, then the model's, then classes of what the samples do not hold
    letters = sorted(model.known - {" "})
    ids = {ch: i for i, ch in enumerate(letters, 1)}
    digit, other_ascii, mark, sign, symbol, unknown, amp = (len(letters) + k for k in range(1, 8))
    size = len(letters) + 8
    table = np.full(0x110000, unknown, dtype=np.int32)
    for code in range(0x20000):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch in " \t\r\n":
            table[code] = 0
        elif ch == "&":
            table[code] = amp
        elif kind == "Nd":
            table[code] = ids.get("0", digit) if code < 128 else ids.get(ch, unknown if code < 0x600 else digit)
        elif (known := ids.get(folded(ch))) is not None:
            table[code] = known
        elif code < 128:
            table[code] = other_ascii
        elif 0x610 <= code <= 0x61A or 0x640 <= code <= 0x652 or code in (0x670, 0x200C) or (kind[0] == "P" and 0x600 <= code <= 0x6FF):
            table[code] = mark  # vowel marks, joiners and stops, which any Arabic letter may have
        elif kind[0] == "P" or kind == "No":
            table[code] = sign
        elif kind[0] == "S" and code != 0xFFFD:
            table[code] = symbol
    plain = {0, digit, other_ascii, amp} | {i for ch, i in ids.items() if ch.isascii()}
    arabic = {mark} | {i for ch, i in ids.items() if "\u0600" <= ch <= "\u06ff"}
    value = np.full((size, size), model.rare, dtype=np.float32)
    for (a, b), x in model.value.items():
        value[ids.get(a, 0), ids.get(b, 0)] = x
    letter = {i for ch, i in ids.items() if ch.isalpha()}
    for i in range(size):
        for j in range(size):
            if i in plain and j in plain:
                value[i, j] = 0.0  # pairs of ASCII characters tell nothing
            elif unknown in (i, j):
                value[i, j] = model.odd
            elif symbol in (i, j):
                # a currency or mathematical sign stands beside digits and blanks, a garbled letter's beside letters
                other = i + j - symbol
                value[i, j] = model.odd if other in letter or other == symbol else -2.0
            elif sign in (i, j):
                # a sign beside a letter beyond ASCII may be the rest of a garbled one
                other = i + j - sign
                value[i, j] = -2.0 if other in plain or other == sign or other == mark else model.odd
            elif mark in (i, j):
                value[i, j] = -2.0 if i + j - mark in arabic or i + j - mark in plain - letter else model.odd
            elif (i in arabic and i in letter and j in letter and j not in arabic) or (j in arabic and j in letter and i in letter and i not in arabic):
                value[i, j] = model.odd
    value[amp, [i for i in letter if i in plain] + ([ids["#"]] if "#" in ids else [other_ascii])] = model.odd
    counted = np.ones((size, size), dtype=np.int64)
    counted[np.ix_(sorted(plain), sorted(plain))] = 0
    # one sum holds three: 64ths of logarithms, pairs that count, and pairs of unlike characters
    packed = (np.rint(value * 64).astype(np.int64) + (counted << 31) + ((value <= model.odd).astype(np.int64) << 52)).reshape(-1)
    table = table.astype(np.int16)

    def suspects(texts: list[str]) -> list[list[tuple[int, int]]]:
        joined = "\n".join(texts) + "\n"
        classes = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        pair = classes[:-1].astype(np.int32)
        pair *= size
        pair += classes[1:]
        sums = np.zeros(len(pair) + 1, dtype=np.int64)
        np.cumsum(packed[pair], out=sums[1:])
        # words end at blanks; the pairs with the blanks on both sides belong to the word
        ends = np.flatnonzero(classes == 0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        whole = sums[np.minimum(ends, len(pair))] - sums[np.maximum(starts - 1, 0)]
        likely = ((whole + (1 << 30)) & ((1 << 31) - 1)) - (1 << 30)
        n = ((whole - likely) >> 31) & ((1 << 21) - 1)
        hit = (ends > starts) & ((whole >> 51 > 0) | ((n >= 3) & (likely < UNLIKELY * 64 * n)) | (ends - starts > LONG_WORD))
        limits = np.cumsum([len(t) + 1 for t in texts])
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        owner = np.searchsorted(limits, starts[hit], side="right")
        for k, start, stop in zip(owner.tolist(), starts[hit].tolist(), ends[hit].tolist()):
            base = int(limits[k - 1]) if k else 0
            runs = out[k]
            if runs and runs[-1][1] == start - base - 1 and joined[start - 1] == " ":
                runs[-1] = (runs[-1][0], stop - base)
            else:
                runs.append((start - base, stop - base))
        return out

    return suspects


def make_symbols(swaps: list[Swap]) -> Callable[[str], list[str]]:
    """A function that cuts a word into symbols: runs that are one UTF-8 letter in some reading, else characters."""
    finders = [s for s in swaps if s.utf8]

    def cut(word: str) -> list[str]:
        spans: dict[int, int] = {}
        for swap in finders:
            for m in swap.find.finditer(word):
                if swap.letter(m.group()):
                    spans[m.start()] = max(spans.get(m.start(), 0), m.end())
        out, i = [], 0
        while i < len(word):
            end = spans.get(i, i + 1)
            out.append(word[i:end])
            i = end
        return out

    return cut


_REFS = re.compile(r"&(?:#[xX]([0-9A-Fa-f]{2,6})|#(\d{3,7})|([A-Za-z]{2,8}[0-9]{0,2}));")


def without_references(text: str) -> str:
    """Character references of characters beyond ASCII, by number or name, as the characters they name."""

    def name(m: re.Match) -> str:
        code = int(m.group(1), 16) if m.group(1) else int(m.group(2)) if m.group(2) else name2codepoint.get(m.group(3), 0)
        return chr(code) if 0x80 <= code < 0xD800 or 0xE000 <= code < 0x110000 else m.group()

    return _REFS.sub(name, text) if "&" in text else text


def _count_symbols() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        swaps = [s for s in all_swaps() if s.utf8]
        cut = make_symbols(swaps)
        leads = frozenset(ch for s in swaps for ch, byte in s.bytes.items() if 0xC2 <= byte < 0xF5)
        memory: dict[str, list[tuple[str, str, int]]] = {}

        def pairs(word: str) -> list[tuple[str, str, int]]:
            """Neighbouring symbols of a word; with a count of 0 the symbols that show where it was garbled twice."""
            if word.isascii():
                return []
            symbols = cut(word)
            chain = [" ", *symbols, " "]
            found = [(a, b, 1) for a, b in zip(chain, chain[1:])]
            if sum(len(s) > 1 for s in symbols) > 1:
                inner = {"".join((swap.letter(s) or s) if len(s) > 1 else s for s in symbols) for swap in swaps} - {word}
                found += [(" ", s, 0) for x in inner if not leads.isdisjoint(x) for s in cut(x) if len(s) > 1]
            return found

        for batch in batches:
            counts: Counter = Counter()
            for source, runs in zip(batch["source"], batch["runs"]):
                for part in runs:
                    for word in without_references(part["run"]).split(" "):
                        if word not in memory:
                            if len(memory) > 200_000:
                                memory.clear()
                            memory[word] = pairs(word)
                        for a, b, n in memory[word]:
                            counts[source, a, b] += n
            rows = [(*k, n) for k, n in counts.items()]
            yield pd.DataFrame(rows, columns=["source", "a", "b", "n"])

    return run


class Plain:
    """The letters of the model with their probabilities and those of their pairs, as arrays; the last letter is any unknown one."""

    def __init__(self, model: Model) -> None:
        import numpy as np

        self.letters = sorted(model.known)
        self.ids = {ch: i for i, ch in enumerate(self.letters)}
        self.unknown = len(self.letters)
        total = sum(model.count.values()) or 1
        self.share = np.array([model.count[ch] / total for ch in self.letters] + [1e-5])
        names = [*self.letters, "\0"]
        self.pair = np.array([[math.exp(model.pair(a, b)) for b in names] for a in names])
        self.joint = self.share[:, None] * self.pair
        self.beyond = np.array([not ch.isascii() for ch in self.letters] + [False])

    def id_of(self, ch: str) -> int:
        return self.ids.get(folded(ch), self.unknown)


class Cipher:
    """Emission probabilities of the symbols of one cipher, fitted to counts of symbol pairs by expectation-maximization."""

    def __init__(self, plain: Plain, domain: list[str], fixed: list[str], prior, weights) -> None:
        import numpy as np

        self.plain, self.domain = plain, domain
        self.place = {s: i for i, s in enumerate([*domain, *fixed])}
        self.prior = prior  # (letters, symbols): observations each reading counts for
        self.known = np.zeros((len(plain.share), len(fixed)))
        for i, s in enumerate(fixed):
            self.known[plain.id_of(s), i] = 1.0
        self.emit = self._normal(prior * weights)

    def _normal(self, seen):
        import numpy as np

        self.seen = seen  # expected observations of (letter, symbol)
        rows = seen.sum(axis=1, keepdims=True)
        return np.concatenate([seen / np.maximum(rows, 1e-30), self.known], axis=1)

    def worth(self):
        """Probability of each pair of symbols."""
        return self.emit.T @ (self.plain.joint @ self.emit)

    def fit(self, weight) -> None:
        """One step: weight is, for each pair, its count times the cipher's share in it over the pair's probability."""
        here = self.emit * (self.plain.joint @ self.emit @ weight.T) + self.emit * (self.plain.joint.T @ self.emit @ weight)
        self.emit = self._normal(here[:, : len(self.domain)] + self.prior)

    def readings(self) -> dict[str, tuple[int, float]]:
        """Most likely letter of each symbol, with its probability."""
        import numpy as np

        seen = self.seen / np.maximum(self.seen.sum(axis=0), 1e-300)
        best = seen.argmax(axis=0)
        return {s: (int(best[i]), float(seen[best[i], i])) for i, s in enumerate(self.domain)}


def learn_ciphers(pairs: list[tuple[str, str, int]], model: Model, swaps: list[Swap], rounds: int = ROUNDS) -> dict[str, dict[str, tuple[str, float]]]:
    """Cipher name -> symbol -> (letter, probability), by expectation-maximization over counted neighbours of one source.

    Every known swap is one cipher of a mixture, whose prior is its reading; every letter of the model's alphabets is
    a candidate. One more cipher without prior is learnt from the pairs that none of them explains; see _free_cipher.
    """
    import numpy as np

    plain = Plain(model)
    pairs = sorted(pairs)
    symbols = sorted({x for a, b, _ in pairs for x in (a, b)})
    fixed = [s for s in symbols if s.isascii() and folded(s) in plain.ids]
    high = [s for s in symbols if not s.isascii()]
    first, second = [a for a, _, _ in pairs], [b for _, b, _ in pairs]
    n = np.array([float(c) for _, _, c in pairs])

    def identity(a: str, b: str) -> float:
        chain = [*map(folded, a + b)]
        return plain.share[plain.id_of(chain[0])] * math.exp(sum(model.pair(x, y) for x, y in zip(chain, chain[1:])))

    own = np.array([identity(a, b) for a, b in zip(first, second)])
    seen = Counter()
    for a, b, c in pairs:
        seen[a] += c
        seen[b] += c
    ciphers: dict[str, tuple[Cipher, np.ndarray, np.ndarray, np.ndarray]] = {}
    for swap in swaps:
        # the parts of longer symbols are symbols of the other swaps
        mine = high if swap.utf8 else sorted(set("".join(high)))
        readings = {s: letter for s in mine if (letter := swap.letter(s)) is not None}
        if not readings:
            continue
        domain = sorted(readings)
        # every code page holds ASCII, so that no symbol stands for an ASCII letter
        prior = np.repeat((0.03 * PRIOR_WEIGHT / max(1, plain.beyond.sum())) * plain.beyond[:, None], len(domain), axis=1)
        for i, s in enumerate(domain):
            prior[plain.id_of(readings[s]), i] += 0.97 * PRIOR_WEIGHT
        cipher = Cipher(plain, domain, fixed, prior, np.array([1.0 + seen[s] for s in domain]))
        at = np.array([k for k, (a, b) in enumerate(zip(first, second)) if (a in readings or b in readings) and a in cipher.place and b in cipher.place], dtype=int)
        if len(at):
            ciphers[swap.name] = (cipher, at, np.array([cipher.place[first[k]] for k in at]), np.array([cipher.place[second[k]] for k in at]))
    share = {name: 0.5 / max(1, len(ciphers)) for name in ciphers}
    own_share = 0.5
    likely: dict[str, np.ndarray] = {}
    live = list(ciphers)
    for step in range(rounds):
        for name in live:
            c, _, i, j = ciphers[name]
            likely[name] = np.maximum(c.worth()[i, j], 1e-300)
        total = own_share * own + 1e-300
        for name, (_, at, _, _) in ciphers.items():
            total[at] += share[name] * likely[name]
        spent, weights = {}, {}
        for name, (_, at, _, _) in ciphers.items():
            weights[name] = n[at] * share[name] / total[at]
            spent[name] = float((weights[name] * likely[name]).sum())
        # what explains next to nothing stays as its prior has it
        live = [name for name in live if step < 2 or spent[name] >= 5 * PRIOR_WEIGHT]
        for name in live:
            cipher, _, i, j = ciphers[name]
            weight = np.zeros((len(cipher.place),) * 2)
            weight[i, j] = weights[name]
            cipher.fit(weight)
        own_spent = float((n * own_share * own / total).sum())
        every = own_spent + sum(spent.values()) + 1.0
        own_share = (own_spent + 0.5) / every
        share = {name: (x + 0.5 / len(spent)) / every for name, x in spent.items()}
    out: dict[str, dict[str, tuple[str, float]]] = {}
    best = own.copy()
    by_name = {s.name: s for s in swaps}
    for name, (cipher, at, i, j) in ciphers.items():
        best[at] = np.maximum(best[at], cipher.worth()[i, j])
        table, seen_as = {}, cipher.readings()
        for k, s in enumerate(cipher.domain):
            reading, (letter, p) = by_name[name].letter(s), seen_as[s]
            at_reading, whole = cipher.seen[plain.id_of(reading), k], cipher.seen[:, k].sum()
            if letter != plain.id_of(reading) and letter != plain.unknown and p >= OVERRULE and whole >= OVERRULE_SEEN and not all(folded(ch) in plain.ids for ch in s):
                table[s] = (plain.letters[letter], p)
            else:
                table[s] = (reading, max(LEAST_TRUST, float(at_reading / max(whole, 1e-300))))
        out[name] = table
    if free := _free_cipher(first, second, n, best, seen, fixed, model, plain):
        out[FREE] = free
    return out


def _free_cipher(first, second, n, best, seen: Counter, fixed: list[str], model: Model, plain: Plain) -> dict[str, tuple[str, float]]:
    """The table of a cipher without any prior, or nothing.

    Unexplained is a pair whose symbols meet far more often than any known cipher or plain text says. The cipher needs FREE_PAIRS of
    them, and its plain text must be as likely a pair as the samples' own, up to FREE_LOSS: the words of another
    language stay unlikely under every one-to-one mapping of their letters.
    """
    import numpy as np

    whole = float(n.sum())
    freq = {s: c / (2 * whole) for s, c in seen.items()}
    odd = np.array([x < 0.01 * freq[a] * freq[b] for a, b, x in zip(first, second, best)])
    unexplained, among = Counter(), Counter()
    for a, b, c, o in zip(first, second, n, odd):
        for s, other in ((a, b), (b, a)):
            unexplained[s] += c if o else 0
            among[s] += 0 if other.isascii() else c
    # out of place: no letter of the samples' scripts, unless its neighbours are beyond ASCII, too
    lone = [s for s in sorted(seen) if len(s) == 1 and not s.isascii() and ord(s) < 0x2600 and unexplained[s] >= 0.6 * seen[s]]
    domain = [s for s in lone if among[s] >= 0.5 * seen[s] or not (s in plain.ids or unicodedata.name(s, "").startswith(("LATIN", "ARABIC")))]
    if sum(unexplained[s] for s in domain) < 2 * FREE_PAIRS or len(domain) < FREE_SYMBOLS:
        return {}
    candidates = plain.beyond
    place = {s: i for i, s in enumerate([*domain, *fixed])}
    at = np.array([k for k, (a, b) in enumerate(zip(first, second)) if a in place and b in place and not (a.isascii() and b.isascii())], dtype=int)
    i, j = np.array([place[first[k]] for k in at]), np.array([place[second[k]] for k in at])
    count = n[at]
    rng = np.random.default_rng(11)
    found: tuple[float, dict] = (-math.inf, {})
    for _ in range(4):
        start = (plain.share * candidates)[:, None] * rng.uniform(0.5, 1.5, (len(plain.share), len(domain)))
        cipher = Cipher(plain, domain, fixed, np.zeros_like(start) + 1e-6 * candidates[:, None], np.ones(len(domain)))
        cipher.emit = cipher._normal(start * np.array([seen[s] for s in domain]))
        value = -math.inf
        for _ in range(FREE_ROUNDS):
            likely = np.maximum(cipher.worth()[i, j], 1e-300)
            value = float((count * np.log(likely)).sum())
            weight = np.zeros((len(place),) * 2)
            weight[i, j] = count / likely
            cipher.fit(weight)
        if value > found[0]:
            found = (value, cipher.readings())
    table = {s: (plain.letters[x], p) for s, (x, p) in found[1].items() if x < plain.unknown}
    shown = lambda s: folded(table[s][0]) if s in table else folded(s)
    mean = float(sum(c * model.pair(shown(first[k]), shown(second[k])) for k, c in zip(at, count)) / count.sum())
    whole = sum(seen[s] for s in domain)
    sure = sum(seen[s] * p for s, (_, p) in table.items()) / whole
    # a letter may have two symbols, capital and small
    takers = Counter()
    doubles = 0
    for s in sorted(table, key=lambda s: (-seen[s], s)):
        takers[table[s][0]] += 1
        doubles += seen[s] if takers[table[s][0]] > 2 else 0
    return table if mean >= model.usual - FREE_LOSS and sure >= FREE_SURE and doubles <= 0.05 * whole else {}


def make_restorer(model: Model, swaps: list[Swap]) -> Callable[[str, dict[str, dict[str, list]]], tuple[str, float, bool]]:
    """A function (run, learnt tables) -> (restored run, gain, whether it is garbled). It maps by the best table, twice if need be."""
    finders = {s.name: s for s in swaps}
    score = model.scorer()
    memory: dict[tuple[str, int], tuple[str, float, bool]] = {}

    def once(run: str, tables: dict[str, dict[str, list]]) -> tuple[str, float]:
        base, best = None, (run, 0.0)
        worth: dict[str, float] = {}
        chars = set(run)
        letters = 0
        for name, table in tables.items():
            swap = finders.get(name)
            if swap and swap.utf8:
                used = {s for s in swap.find.findall(run) if s in table}
                if not used:
                    continue
                out = swap.find.sub(lambda m: table[m.group()][0] if m.group() in table else m.group(), run)  # noqa: B023
            else:
                used = chars & table.keys()
                if not used:
                    continue
                if name != FREE:
                    hits, letters = sum(map(run.count, used)), letters or sum(map(str.isalpha, run))
                    if hits < 3 or hits < 0.4 * letters:
                        continue  # a few such letters in a word are more likely its own
                out = run.translate({ord(s): table[s][0] for s in used})
            if base is None:
                base = score(run)
            if out not in worth:
                worth[out] = score(out) - base
            gain = worth[out] + sum(math.log(max(table[s][1], 1e-4)) for s in used) / len(used)
            if gain > best[1]:
                best = (out, gain)
        return best

    def restore(run: str, tables: dict[str, dict[str, list]]) -> tuple[str, float, bool]:
        key = (run, id(tables))
        if (seen := memory.get(key)) is not None:
            return seen
        plain = without_references(run)
        out, gain = once(plain, tables)
        if gain >= MARGIN:
            again, more = once(out, tables)
            if more >= MARGIN:
                out, gain = again, gain + more
            answer = (out, gain, True)
        else:
            answer = (run, 0.0, "\ufffd" in plain)
        if len(memory) > 50_000:
            memory.clear()
        memory[key] = answer
        return answer

    return restore


def _find_runs(shared, with_text: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        suspects = make_suspects(Model.of(shared.value))
        for whole in batches:
            texts = whole["text"].tolist()
            start = 0
            while start < len(texts):
                # so many texts at once that their arrays stay small
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= 2_000_000):
                    size += len(texts[stop])
                    stop += 1
                part = texts[start:stop]
                found = suspects(part)
                if keep := [k for k, places in enumerate(found) if places]:
                    yield pd.DataFrame({
                        "doc_id": whole["doc_id"].to_numpy()[start:stop][keep],
                        "source": whole["source"].to_numpy()[start:stop][keep],
                        "text": [part[k] if with_text else None for k in keep],
                        "runs": [[{"start": a, "stop": b, "run": part[k][a:b]} for a, b in found[k]] for k in keep],
                    })
                start = stop

    return run


def _suspicious(documents: DataFrame, shared, with_text: bool) -> DataFrame:
    """(doc_id, source, text, runs) of the documents with suspicious runs, written to the shared folder: learning and restoring both read them."""
    rows = documents.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source")).filter("doc_id is not null and text is not null")
    # a text of as many bytes as characters and without & holds nothing to examine
    rows = rows.filter((F.octet_length("text") != F.length("text")) | F.contains("text", F.lit("&")))
    return checkpoint(rows.mapInPandas(_find_runs(shared, with_text), _RUNS))


def _learnt(runs: DataFrame, shared) -> DataFrame:
    counts = runs.select("source", "runs").mapInPandas(_count_symbols(), "source string, a string, b string, n bigint").groupBy("source", "a", "b").agg(F.sum("n").alias("n"))

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = learn_ciphers(list(zip(pdf["a"], pdf["b"], pdf["n"].astype(int))), Model.of(shared.value), all_swaps())
        tables = {name: {s: [letter, round(p, 4)] for s, (letter, p) in table.items()} for name, table in found.items() if table}
        return pd.DataFrame([(key[0], json.dumps(tables, ensure_ascii=False, sort_keys=True))], columns=["source", "mapping"])

    return counts.groupBy("source").applyInPandas(learn, "source string, mapping string")


def learnt_mappings(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(source, mapping): per source a JSON object from cipher to symbol to [letter, probability], as learnt by EM."""
    shared = documents.sparkSession.sparkContext.broadcast(pair_counts(samples, model_pairs))
    return _learnt(_suspicious(documents, shared, False), shared)


def _restore(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = make_restorer(Model.of(shared.value), all_swaps())
        read: dict[str, dict] = {}
        for batch in batches:
            rows = []
            for doc_id, text, places, mapping in zip(batch["doc_id"], batch["text"], batch["runs"], batch["mapping"]):
                if mapping not in read:
                    read[mapping] = json.loads(mapping) if mapping else {}
                pieces, at, n, total, lossy = [], 0, 0, 0.0, False
                for place in places:
                    fixed, gain, garbled = restore(place["run"], read[mapping])
                    n, total, lossy = n + garbled, total + gain, lossy or (garbled and "\ufffd" in fixed)
                    if text is not None:
                        pieces += [text[at : place["start"]], fixed]
                        at = place["stop"]
                if n:
                    rows.append((doc_id, None if text is None else "".join(pieces) + text[at:], n, total, lossy))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "runs", "gain", "is_lossy"])

    return run


def _restored(documents: DataFrame, samples: DataFrame, with_text: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(pair_counts(samples, model_pairs))
    runs = _suspicious(documents, shared, with_text)
    rows = runs.join(_learnt(runs, shared), "source", "left").select("doc_id", "text", "runs", "mapping")
    return rows.mapInPandas(_restore(shared), "doc_id bigint, restored string, runs int, gain double, is_lossy boolean")


def restored_texts(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, restored, runs, gain, is_lossy) of documents with garbled passages.

    restored: the text with every garbled run mapped back; is_lossy: characters are lost for good. Null, empty and
    clean texts have no row; a null source counts as one source of its own; repeated rows give repeated rows; without
    samples only lost characters are found; an empty table gives an empty result.
    """
    return _restored(documents, samples, True)


def mojibake_found(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id) of documents with at least one passage decoded with a wrong encoding."""
    return _restored(documents, samples, False).select("doc_id").distinct()
