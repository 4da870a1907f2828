"""One form for text that looks the same: compatibility forms, composed accents, spaces, hyphens, look-alike letters."""

from __future__ import annotations

import unicodedata

# Letters of other scripts that look like a Latin letter, in alphabetical order of the Latin letters.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ѵν",
    "w": "ԝ", "x": "хχ", "y": "уγ",
}
# Capitals that look alike only as capitals keep their own small letters; У looks like Y.
LOOKALIKES["Y"] += "У"
# Kinds of hyphen.
HYPHENS = "‐‑﹣－"
#: decompositions that change what is read
KEPT = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")

_LATIN = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others}
# Where case doesn't count, the small letter of a capital look-alike is the same letter too: В, в, B and b are one, or a
# word in capitals would differ from itself in small letters.
SMALL = {ord(c.lower()): latin.lower() for latin, others in LOOKALIKES.items() for c in others if ord(c.lower()) not in _LATIN and len(c.lower()) == 1}


def ignorable(o: int) -> bool:
    """Default-ignorable code points: they have no width and no look of their own."""
    return (
        o in (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0)
        or 0x180B <= o <= 0x180F or 0x200B <= o <= 0x200F or 0x202A <= o <= 0x202E or 0x2060 <= o <= 0x206F
        or 0xFE00 <= o <= 0xFE0F or 0xFFF0 <= o <= 0xFFF8 or 0x1BCA0 <= o <= 0x1BCA3 or 0x1D173 <= o <= 0x1D17A or 0xE0000 <= o <= 0xE0FFF
    )


class Forms(dict):
    """A table for str.translate that is filled by rule on demand, once per distinct character."""

    def __init__(self, letters: bool = True, hyphens: bool = True, fold: bool = False, merge: bool = False):
        super().__init__()
        self.letters, self.hyphens, self.fold, self.small = letters, hyphens, fold, SMALL if merge else {}

    def __missing__(self, o: int):
        if ignorable(o):
            got = None
        else:
            c = chr(o)
            tag = unicodedata.decomposition(c).partition(" ")[0]
            if unicodedata.category(c) == "Zs":
                got = " "
            elif self.hyphens and c in HYPHENS:
                got = "-"
            elif tag.startswith("<") and tag not in KEPT:
                k = unicodedata.normalize("NFKC", c)
                got = k if not k.startswith(" ") else c  # spacing accents stay
                got = "".join(self._one(x) for x in unicodedata.normalize("NFD", got))
            else:
                got = "".join(self._one(x) for x in unicodedata.normalize("NFD", c))
            if self.fold:
                got = "".join(self.small.get(ord(y), y) for x in unicodedata.normalize("NFD", got.casefold()) for y in self._one(x))
            got = o if got == c else got
        self[o] = got
        return got

    def _one(self, c: str) -> str:
        if self.hyphens and c in HYPHENS:
            return "-"
        return _LATIN.get(ord(c), c) if self.letters else c


_LOOKS = Forms()
_FOLDED = Forms(fold=True)
_MERGED = Forms(fold=True, merge=True)
_COMPATIBLE = Forms(letters=False, hyphens=False)


def looks(text: str, fold_case: bool = False, merge: bool = False) -> str:
    """The form in which texts that read the same are equal. Letter case, accents, other digits, superscripts, circled
    digits and line breaks stay different; fold_case also folds case fully (for comparisons that ignore it), and merge
    then takes small letters for one whose capitals look alike."""
    if text.isascii():
        return text.lower() if fold_case else text
    return unicodedata.normalize("NFC", text.translate(_MERGED if fold_case and merge else _FOLDED if fold_case else _LOOKS))


def clean(text: str) -> str:
    """Readable consistent text: as `looks`, but letters stay in their script and hyphens as they are."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_COMPATIBLE))
