"""The cascade tokeniser: runs of one script, then six steps that split and merge them; an alternative to the lattice.

A token is (surface, part of speech, begin, end, lemma). Steps keep spans exact: the surfaces are slices of the text.
"""

from __future__ import annotations

import re

from kumiki.operators.tokenizer import GRAMMAR, INFLECTION, NO_WORDS, RUN_POS, RUNS, Surfaces, conjugation, script, tokenize

Token = tuple[str, str, int, int, str]
SMALL_KANA = "ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮー"
EMPHATIC = re.compile("^(.)[っッ](.)\\1\\2$")
#: Kana that a verb's stem may end with between two kanji (rows i and e), as in 受け付け.
LINKING = re.compile("^[いきしちにみりぎじびけせてねべめれえげぜでひへ]{1,2}$")
KANJI = re.compile("^[一-鿿々]+$")
ADJECTIVE_END = re.compile("(い|かった|く|くて)$")


def runs(text: str) -> list[Token]:
    """Runs of one script, without white space."""
    found = ((m[0], RUN_POS.get(script(m[0]), "記号"), m.start(), m.end()) for m in RUNS.finditer(text))
    return [(*t, t[0]) for t in found if t[1] != "空白"]


def keep_whole(tokens: list[Token], text: str, words: Surfaces) -> list[Token]:
    """Words that stay whole: the longest claim first, and tokens are cut at a claim's edges or joined within it."""
    taken = bytearray(len(text))
    claims = []
    for b, e, pos in sorted(words.find(text), key=lambda x: (x[0] - x[1], x[0])):
        if not any(taken[b:e]):
            taken[b:e] = b"\1" * (e - b)
            claims.append((b, e, pos))
    if not claims:
        return tokens
    out: list[Token] = [(text[b:e], pos, b, e, text[b:e]) for b, e, pos in claims]
    for s, pos, b, e, _ in tokens:
        begin = None
        for i in range(b, e + 1):
            free = i < e and not taken[i]
            if free and begin is None:
                begin = i
            elif not free and begin is not None:
                out.append((text[begin:i], pos, begin, i, text[begin:i]))
                begin = None
    return sorted(out, key=lambda t: t[2])


def fold_emphatic(tokens: list[Token]) -> list[Token]:
    """An emphatic form (ドッキドキ) has the doubled word (ドキドキ) as its lemma."""
    out = []
    for s, pos, b, e, lemma in tokens:
        m = EMPHATIC.match(s)
        out.append((s, "副詞", b, e, (m[1] + m[2]) * 2) if m else (s, pos, b, e, lemma))
    return out


def split_hiragana(tokens: list[Token], words: Surfaces) -> list[Token]:
    """Runs of hiragana by their cheapest path over grammar words and known ones."""
    out: list[Token] = []
    for t in tokens:
        if t[1] == "未知語" and len(t[0]) > 1:
            out += [(s, pos, t[2] + b, t[2] + e, s) for s, pos, b, e in tokenize(t[0], words)]
        else:
            pos = next((p for b, e, ways in GRAMMAR.find(t[0]) if e - b == len(t[0]) for _, p in ways), t[1]) if t[1] == "未知語" else t[1]
            out.append((t[0], pos, *t[2:]))
    return out


def merged(a: Token, b: Token, pos: str, lemma: str | None = None) -> Token:
    whole = a[0] + b[0]
    return (whole, pos, a[2], b[3], lemma or whole)


def merge_names(tokens: list[Token]) -> list[Token]:
    """A token that begins with a small kana or a long-vowel mark belongs to the one before it, as a name."""
    out: list[Token] = []
    for t in tokens:
        if out and out[-1][3] == t[2] and t[0][0] in SMALL_KANA and out[-1][1] not in ("助詞", "助動詞", "記号"):
            out[-1] = merged(out[-1], t, "名詞-固有名詞")
        else:
            out.append(t)
    return out


def merge_okurigana(tokens: list[Token]) -> list[Token]:
    """Kanji, linking kana and kanji are one noun, with a linking kana that follows (受け付け, 申し込み)."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        near = lambda k: i + k < len(tokens) and tokens[i + k][2] == tokens[i + k - 1][3]  # noqa: E731, B023
        if KANJI.match(t[0]) and len(t[0]) <= 2 and near(1) and LINKING.match(tokens[i + 1][0]) and near(2) and KANJI.match(tokens[i + 2][0]) and len(tokens[i + 2][0]) <= 2:
            whole = merged(merged(t, tokens[i + 1], ""), tokens[i + 2], "名詞-普通名詞")
            i += 3
            rest = None
            if i < len(tokens) and tokens[i][2] == whole[3] and LINKING.match(tokens[i][0][0]):
                s, pos, b, e, _ = tokens[i]
                if len(s) == 1 or s[1:] in GRAMMAR.known:  # the linking kana, and perhaps a particle after it
                    whole = merged(whole, (s[0], pos, b, b + 1, s[0]), "名詞-普通名詞")
                    rest = (s[1:], GRAMMAR.known[s[1:]][0][1], b + 1, e, s[1:]) if len(s) > 1 else None
                    i += 1
            out += [whole, rest] if rest else [whole]
        else:
            out.append(t)
            i += 1
    return out


def refine_pos(tokens: list[Token], text: str) -> list[Token]:
    """Kanji of one or two with an inflected ending are a verb or an adjective, with its dictionary form as lemma."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        tail = INFLECTION.match(text, t[3]) if KANJI.match(t[0]) and len(t[0]) <= 2 else None
        end = tail.end() if tail else 0
        j = i + 1
        while tail and j < len(tokens) and tokens[j][2] == tokens[j - 1][3] and tokens[j][3] <= end:
            j += 1
        if tail and j > i + 1 and tokens[j - 1][3] == end:
            whole = text[t[2] : end]
            pos = "形容詞" if ADJECTIVE_END.search(whole) and not whole.endswith("ない") else "動詞"
            out.append((whole, pos, t[2], end, conjugation(whole, pos)[0]))
            i = j
        else:
            out.append(t)
            i += 1
    return out


def cascade(text: str, dictionary: dict[str, str] | Surfaces | None = None) -> list[Token]:
    """Tokens of a text by all six steps."""
    words = dictionary if isinstance(dictionary, Surfaces) else Surfaces(dictionary) if dictionary else NO_WORDS
    tokens = fold_emphatic(keep_whole(runs(text), text, words))
    tokens = merge_okurigana(merge_names(split_hiragana(tokens, words)))
    return refine_pos(tokens, text)
