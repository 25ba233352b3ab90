"""Problem 5: page boilerplate, by union-free regular expressions inferred for each site.

The lines of a site's pages are token streams. A token is a whole line, or where lines differ a line with a slot of text
after or before what they share. Streams are aligned one after the other into a wrapper of fixed, optional and repeated
tokens with text between; partial wrappers of parts of a site's pages are merged in the same way. Each line is looked up
in its site's wrapper: tokens before and after the text are the frame's, and so are bare lines that stand amid the text
of many pages. A wrapper's places are judged one by one: a token that pages have twice, in a menu and as a heading say, is
the frame's in one place and not in the other, and a token of few pages is the frame's in a place between those of its
fixed tokens. Pages with such tokens are aligned with the wrapper, and each line takes the judgement of the place it falls
on. What no wrapper settles (pages without site, tokens of too few pages, prompts amid the text) falls back on cues: fixed
phrases of page frames.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.lines import chunk_rows, site_of
from sparkweave.llm.p3_encoding import Repair
from sparkweave.operators.skew import skew_lookup
from sparkweave.session import materialize

#: Pages folded into one partial wrapper, wrappers merged at once, and pages from which a token counts as fixed.
PART, MERGED, FIXED = 256, 64, 3
#: Part of a site's pages from which a token of the outer wrapper is the frame's, the same of one with a slot of text,
#: and of a bare line amid the text; pages from which the latter two count.
SHARE, SLOT_SHARE, AMID_SHARE, CERTAIN = 0.02, 0.1, 0.2, 5
#: Lines from a page's start and end that are its edge, and words that sentences with a slot share.
EDGE, OPENING = (4, 5), 4
TEXT = "#text"
#: Mark of a token that is the beginning of a sentence.
OPENS = "^"

# Phrases of page frames in the languages of the pages. They are compared in lower case, with figures as 0.
EQUAL = """
menu|toggle navigation|choose your edition|search|log in|sign in|sign in to your account|skip to main content|skip to content|back to top|home|newsletter|copy link|print|print this page
email a friend|save for later|advertisement|advertising|sponsored content|related stories|most read|popular this week|trending now|from our archive|in this section|you may also like|subscribe
sign up for our weekly letter|terms & conditions apply|share|share this article|share this article with a neighbour|like what you’re reading? pass it on.|like what you're reading? pass it on.
zum inhalt springen|menü|menü öffnen|suche|drucken|artikel teilen|für später merken|anzeige|werbung|meistgelesen|ähnliche beiträge|das könnte sie auch interessieren|nach oben|anmelden
aller au contenu|menu principal|rechercher|imprimer|partager cet article|publicité|les plus lus|à lire aussi|dans la même rubrique|haut de page|se connecter
saltar al contenido|menú|buscar|imprimir|compartir este artículo|publicidad|lo más leído|también le puede interesar|artículos relacionados|volver arriba|iniciar sesión
ir para o conteúdo|pesquisar|partilhar este artigo|compartilhar este artigo|publicidade|mais lidas|também lhe pode interessar|informação relacionada|voltar ao topo|impressão
перейти к содержанию|меню|поиск|распечатать|поделиться статьёй|поделиться|реклама|самое читаемое|похожие статьи|вам может быть интересно|наверх|войти
vai al contenuto|cerca|stampa|condividi questo articolo|pubblicità|i più letti|potrebbe interessarti|naar de inhoud|zoeken|afdrukken|deel dit artikel|advertentie|meest gelezen
"""
STARTS = """
© |copyright 0|(c) 0|we use cookies|our partners and we set cookies|this site stores small files|by browsing on, you agree|by the |words: |edited by the |updated 0|published 0|last updated|listen to this story
shared 0 times|rate this story|contact the editors|registered in |if you feel unwell, call|opinions are those of the author|reproduction of any part|this page was last reviewed|sign up for the |follow us
also on |read more: |read also: |up next |see also: |» |most read on |cookie settings|privacy policy|privacy |terms of use
wir verwenden cookies|diese seite speichert daten|von der |stand: 0|lesezeit|lesen sie auch|mehr zum thema|nachdruck nur mit|für links auf fremde seiten|die inhalte von |ein angebot der |impressum
nous utilisons des cookies|ce site dépose des traceurs|par la rédaction|mis à jour|temps de lecture|lire aussi|à suivre |les contenus de |toute reproduction|édité par |mentions légales
usamos cookies|este sitio guarda datos|por la redacción|actualizado el|lectura de 0|lea también|más sobre el tema|la información de |prohibida la reproducción|una publicación de |aviso legal
este sítio guarda dados|este site guarda dados|pela redação|atualizado em|leitura de 0|leia também|mais sobre o tema|a informação de |proibida a reprodução|uma publicação de |termos de uso
мы используем файлы|этот сайт хранит|редакция |обновлено 0|время чтения|читайте также|ещё по теме|материалы |перепечатка |издание |правила ·|согласие можно отозвать
utilizziamo cookie|a cura della redazione|aggiornato il|tempo di lettura|leggi anche|riproduzione riservata|wij gebruiken cookies|door de redactie|bijgewerkt op|leestijd|lees ook
"""
WITHIN = """
all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|reservados todos los derechos|todos os direitos reservados|все права защищены|may earn a commission from
is for information only|does not replace the advice|terms of use · imprint|terms & conditions | imprint|without written consent|ersetzen keine ärztliche|ne remplacent pas un avis|no sustituye la opinión
não substitui a opinião|не заменяют консультацию|sans l'accord écrit|sin permiso escrito|sem autorização escrita|без письменного согласия|übernimmt|aviso legal · priv|datenschutz · agb|правила · конфиденциальность
mentions légales · confidentialité|cookie settings / accessibility
"""
ENDS = "min read|minutes read|staff writers|newsroom|-redaktion|for daily updates|comments)|comment)|kommentare)|commentaires)|comentarios)|comentários)|комментариев)|edition"
MENU = """
home|kitchen|memory|panels|shop|news|recipes|podcast|subscribe|contact|archive|research|video|events|about|about us|log in|letters|health|ageing|newsletter|privacy|terms & conditions|imprint|search|topics|menu
startseite|aktuelles|gesundheit|rezepte|archiv|kontakt|über uns|anmelden|themen|accueil|actualités|santé|recettes|archives|abonnements|à propos|se connecter|nous écrire
inicio|noticias|salud|recetas|archivo|suscripción|quiénes somos|iniciar sesión|contacto|privacidad|aviso legal|início|notícias|saúde|receitas|arquivo|assinatura|quem somos|entrar|privacidade
главная|новости|здоровье|рецепты|архив|подписка|о нас|войти|контакты|правила|конфиденциальность|impressum|datenschutz|agb|mentions légales|confidentialité
home page|notizie|salute|ricette|archivio|chi siamo|accedi|contatti|nieuws|gezondheid|recepten|archief|over ons|inloggen
"""
_SIGNS = re.compile(r"\s*[|/·›»>•]\s*|\s{2,}|\t+")
_FIGURES = re.compile(r"[0-9]+")
_SPACES = re.compile(r"[\s ]+")
_NUMBERED = re.compile(r"^\s*[0-9]{1,3}[.)]\s+\S+ \S+ \S+")
_LISTED = re.compile(r"^(?:[-–•*]\s*)?[0-9][0-9.,/]*\s*(?:[^\s]{1,4}|[^\W\d]+)\b")
_MARKS = frozenset("|/·›»>•\t")
_CLOSING, _STOPS, _WIDE_STOPS = "'\"”’»)]", frozenset(".!?…:;"), frozenset("。！？")
_BYLINE = re.compile(r"^(?:By|Von|Par|Por|Di|Door|Автор:?) (?:(?:Dr|Prof)\.? )?[^\W\d_a-zа-я][\w'’.-]*(?: [^\W\d_a-zа-я][\w'’.-]*){0,3}(?:,.*)?$")
#: First letters of bylines, in lower case.
_BYLINES = frozenset("bvpdа")
_CREDITED = re.compile(r"[.!?…]['\"”’»)]*\s*(?:—|–|-|\[|\(|As seen by)\s*[^.!?]{3,40}[\])]?$|[.!?…]['\"”’»)]*\s+As seen by .+$")


def _phrases(block: str) -> list[str]:
    return [p for line in block.strip().split("\n") for p in line.split("|") if p]


def _skeleton(text: str) -> str:
    """The text without letters beyond ASCII and marks of lost ones, for lines of which letters are lost."""
    return "".join(ch for ch in text if ch < "\x80")


class Cues:
    """Tells lines of a page's frame by their phrases."""

    def __init__(self, fold=lambda t: t) -> None:
        keep = lambda block: {q for p in block if len((q := fold(p)).strip()) > 2}
        self.equal, self.menu = keep(_phrases(EQUAL)), keep(_phrases(MENU))
        self.starts, self.within = tuple(keep(_phrases(STARTS))), tuple(keep([*_phrases(WITHIN)]))
        self.ends = tuple(keep(ENDS.split("|")))
        # what phrases begin and end with, to pass most lines by
        self.heads, self.tails, self.firsts = {p[:3] for p in self.starts}, {p[-2:] for p in self.ends}, {p.split(" ")[0] for p in self.menu}

    def frame(self, low: str, parts: list[str]) -> bool:
        if low in self.equal or low in self.menu or low[:3] in self.heads and low.startswith(self.starts) or low[-2:] in self.tails and low.endswith(self.ends):
            return True
        for p in self.within:
            if p in low:
                return True
        named = [p for p in parts if p]
        return len(named) > 1 and sum(p in self.menu for p in named) * 2 >= len(named)


_CUES, _LOST = Cues(), Cues(_skeleton)
#: One for each worker process, so that words are restored once.
_REPAIR = Repair()


@lru_cache(maxsize=1 << 16)
def normal(line: str) -> tuple[str, str]:
    """A line as it was meant, and in lower case with single spaces and figures as 0."""
    text = html.unescape(html.unescape(line)) if "&" in line else line
    return text, _FIGURES.sub("0", " ".join(text.split()).lower())


def _stopped(text: str) -> bool:
    """Whether a stripped text ends in a full stop or the like, be it in quotes."""
    return text.rstrip(_CLOSING)[-1:] in _STOPS or text[-1:] in _WIDE_STOPS


@lru_cache(maxsize=1 << 16)
def is_sentence(text: str) -> bool:
    text = text.strip()
    return _stopped(text) or bool(_CREDITED.search(text))


def _words_in_menu(low: str, cues: Cues) -> bool:
    """Whether a line is made of names of sections set side by side."""
    words, i, found = low.split(" "), 0, 0
    if words[0] not in cues.firsts:
        return False
    while i < len(words):
        for size in (3, 2, 1):
            if " ".join(words[i : i + size]) in cues.menu:
                i += size
                found += 1
                break
        else:
            return False
    return found > 0


#: What a line is: text of the article, of the frame, a heading or title without a full stop, and empty.
ARTICLE, FRAME, BARE, EMPTY = range(4)


@lru_cache(maxsize=1 << 16)
def kind(line: str) -> int:
    text, low = normal(line)
    if not low:
        return EMPTY
    cues = _CUES
    if "�" in low:
        cues, low = _LOST, _SPACES.sub(" ", _skeleton(low)).strip()
        if not re.search(r"\w", low):
            return BARE
        if re.match(r"\S+(?: \S+){0,2} � ", text.strip()) and _skeleton(re.split(" � ", text.strip().lower())[0]).strip() in cues.menu:
            return FRAME
    signs = "  " in text or not _MARKS.isdisjoint(text)
    parts = [_FIGURES.sub("0", p.strip().lower()) for p in _SIGNS.split(text.strip())] if signs else []
    if cues is _LOST:
        parts = [_skeleton(p).strip() for p in parts]
    if _words_in_menu(low, cues):
        return FRAME
    sentence = _stopped(text.strip()) and low.count(" ") > 3
    if "›" in text and len(parts) > 1 and len(parts[0].split()) <= 3 or text.lstrip().startswith("»"):
        return FRAME
    if cues.frame(low, parts):
        # sentences that begin as a byline or prompt does: told apart by what follows
        if sentence and low.startswith(("by the ", "von der ", "privacy ", "материалы ")) and len(low.split(" ")) > 8 and not low.endswith(cues.ends) and not any(p in low for p in cues.within):
            return ARTICLE
        return FRAME
    if not sentence and (low[0].isdigit() and _NUMBERED.match(text) or low.startswith("follow ")) or low[0] in _BYLINES and _BYLINE.match(text.strip()):
        return FRAME
    return ARTICLE if is_sentence(text) else BARE


def places(lines: list[str], first: bool) -> list[int]:
    """Numbers of the lines that are not the article's, of one chunk; ``first`` if it is its page's first.

    A bare line of many words is the title if it stands before the article's first sentence, and else another one's.
    """
    kinds = [kind(x) for x in lines]
    out, begun, titled = [], not first, not first
    for i, (k, line) in enumerate(zip(kinds, lines)):
        if k == FRAME:
            out.append(i)
        elif k == ARTICLE:
            begun = True
        elif k == BARE and len(line.split()) >= 5 and not _LISTED.match(line.strip()):
            if titled and (begun or FRAME in kinds[max(0, i - 1) : i + 2]):
                out.append(i)
            titled = True
    return out


_LABEL = re.compile(r"^(?:(?:\S+ ){0,3}?\S*(?:[:»–—]|0[.)])|»)(?= )")
_BRACKETS = re.compile(r" (\([^()]*\)|\[[^\[\]]*\])$")


@lru_cache(maxsize=4096)
def _brands(site: str) -> list[str]:
    """What of a host may be the site's name on its pages."""
    names = (re.sub(r"(?:news|health)$", "", n) for n in re.split(r"[.-]", site))
    return [n for n in names if len(n) > 4]


@lru_cache(maxsize=1 << 16)
def forms(line: str, site: str) -> tuple[str, ...]:
    """The tokens a line may be in its site's streams: as it is, as cells side by side, with a slot of text after a label
    or its first word(s) or before a figure in brackets; the site's name is a slot too. None for an empty line."""
    text, low = normal(line)
    if not low:
        return ()
    for name in _brands(site):
        low = low.replace(name, "#site")
    if "›" in low:
        return low, "#path"
    out, words = [low], low.split(" ")
    if ("  " in text or not _MARKS.isdisjoint(text)) and len(cells := [c for c in _SIGNS.split(text.strip()) if c]) > 2 and all(len(c.split()) <= 3 for c in cells):
        out.append("#menu")
    if (m := _LABEL.match(low)) and len(words) > 2:
        out.append(f"{m.group()} {TEXT}")
    if (m := _BRACKETS.search(low)) and "0" in m.group(1) and len(words) > 3:
        out.append(f"{TEXT} {m.group(1)}")
    if "0" in words[0] and 1 < len(words) <= 5:
        out.append(f"{TEXT} {' '.join(words[1:])}")
    if len(words) > OPENING + 1 and is_sentence(text):
        out.append(f"{OPENS}{' '.join(words[:OPENING])} {TEXT}")
    return tuple(out)




#: What a token is: a whole line, one with a slot of text, or the beginning of a sentence; the last bits of its number.
WHOLE, SLOT, OPENING_OF = range(3)
#: Token of the text between what is before, amid and after it.
GAP = 0


def named(site: str, token: str) -> int:
    """A token of a site as a number of 64 bits, the last two of which tell what it is."""
    what = OPENING_OF if token.startswith(OPENS) else SLOT if TEXT in token else WHOLE
    h = xxhash.xxh3_64_intdigest(f"{site}\n{token}") & ~3 | what
    return h - (1 << 64) if h >> 63 else h


#: Of each place: token, pages with it there, those with it between two stretches of text, those with it at the edge,
#: those with it in another stretch as well, most times on one page, 1 if bare.
Wrapper = list[list]


def _joined(a: list, b: list) -> list:
    return [a[0], *(x + y for x, y in zip(a[1:5], b[1:5])), max(a[5], b[5]), max(a[6], b[6])]


def align(wrapper: Wrapper, other: Wrapper) -> Wrapper:
    """Two wrappers, or one and a page's stream, as one: what matches is counted, what doesn't becomes an optional token in its place."""
    out: Wrapper = []
    for tag, i, j, k, m in SequenceMatcher(None, [e[0] for e in wrapper], [e[0] for e in other], autojunk=False).get_opcodes():
        out += [_joined(e, f) for e, f in zip(wrapper[i:j], other[k:m])] if tag == "equal" else wrapper[i:j] + other[k:m]
    return out


def outside(token: int, pages: int, n: float, inside: float, edge: float, bare: bool) -> bool:
    """Whether a token that ``n`` of a site's pages have is its frame's."""
    if n < FIXED:
        return False
    if token & 3 == OPENING_OF:
        return n >= CERTAIN and edge >= 0.9 * n and inside * 2 < n
    if token & 3 == SLOT:
        return n >= CERTAIN and n >= SLOT_SHARE * pages and inside * 2 < n
    return inside * 2 < n and n >= SHARE * pages or bare and n >= CERTAIN and n >= AMID_SHARE * pages


#: What a place of a wrapper is: not known to be the frame's, the frame's if the line is short and the page has text of its own, and the frame's.
UNKNOWN, BESIDE, SURE = range(3)


def judged(wrapper: Wrapper, pages: int) -> list[int]:
    """What each place of a site's wrapper is.

    Places of which a page has but one are a token in varying order and are judged together. A place of a whole line is
    judged apart from them if most of its pages have the line in another stretch as well; such places together if most of
    each one's pages have it amid the text, and if not. Lines with a slot are other lines each time: theirs stay together.
    A whole line of too few pages, in no place amid the text, is the frame's if the next places of enough pages are, on
    both sides, or on one if there is none on the other.
    """
    sums: dict[tuple[int, int], list] = {}
    kinds = [(e[0], 0 if e[0] & 3 == SLOT or e[4] * 2 <= e[1] else 1 if e[2] * 2 < e[1] else 2) for e in wrapper]
    for k, e in zip(kinds, wrapper):
        sums[k] = _joined(sums[k], e) if k in sums else e
    frame = {}
    for k, (t, n, inside, edge, again, _, bare) in sums.items():
        # a page with two places counts once where they are judged together
        share = 1 if k[1] else 1 - again / n / 2
        frame[k] = outside(t, pages, n * share, inside * share, edge * share, bool(bare))
    out = [SURE if frame[k] else UNKNOWN for k in kinds]
    # nearest place of enough pages, first to the left, then to the right: whether it is the frame's and not amid the text
    sides = []
    for order in (range(len(wrapper)), range(len(wrapper) - 1, -1, -1)):
        near, side = None, [None] * len(wrapper)
        for i in order:
            side[i] = near
            if wrapper[i][1] >= CERTAIN:
                near = out[i] == SURE and wrapper[i][2] * 2 < wrapper[i][1]
        sides.append(side)
    beside = [True in x and False not in x for x in zip(*sides)]
    amid = {e[0] for e in wrapper if e[2]}
    return [BESIDE if x and what == UNKNOWN and e[0] & 3 == WHOLE and e[0] not in amid else what for e, what, x in zip(wrapper, out, beside)]


class Part:
    """Some pages of a site as streams of tokens."""

    def __init__(self, streams: list[list[tuple[tuple[int, ...], bool, bool]]]) -> None:
        """Of each line its forms, whether it is a sentence, and whether it is long enough for one or for a title."""
        df = Counter(t for s in streams for t in {t for f, *_ in s for t in f})
        self.streams = [[(self._token(f, df), *x) for f, *x in s] for s in streams]
        frame: set[int] = set()
        # where text begins and ends depends on what is frame: a few rounds
        for _ in range(3):
            counts: dict[int, list] = {}
            for s in self.streams:
                seen = set()
                for t, inside, edge, bare, _ in self.stands(s, frame):
                    if t in seen:
                        continue
                    seen.add(t)
                    e = counts.get(t)
                    if e is None:
                        counts[t] = [1, inside, edge, bare]
                    else:
                        e[0] += 1
                        e[1] += inside
                        e[2] += edge
                        e[3] |= bare
            known = frame
            frame = {t for t, (n, inside, edge, bare) in counts.items() if outside(t, len(streams), n, inside, edge, bool(bare))}
            if frame == known:
                break
        self.frame = frame
        # beginnings of sentences that aren't the frame's are text
        self.streams = [[(None if t is not None and t & 3 == OPENING_OF and t not in frame else t, *x) for t, *x in s] for s in self.streams]

    @staticmethod
    def _token(f: tuple[int, ...], df: Counter) -> int | None:
        return next((t for t in f if df[t] >= FIXED), f[0] if df[f[0]] > 1 else None)

    @staticmethod
    def stands(lines: list[tuple[int | None, bool, bool]], frame: set[int]) -> list[tuple[int, int, int, int, list[int]]]:
        """Where a page has its tokens, each once before, amid and after the text: with whether it is amid, whether at the
        edge, whether it is bare, and its lines. Gaps stand where the text begins and where it ends.

        Text is what is no token: it begins with a sentence or title and ends with a sentence. On a page without any the
        sentences are, since the article has to be among them.
        """
        text = [(k, sentence) for k, (t, sentence, long) in enumerate(lines) if long and (t is None or t & 3 == OPENING_OF and t not in frame)]
        first, last = text[0][0] if text else -1, max((k for k, sentence in text if sentence), default=-1)
        out: list[tuple[int, int, int, int, list[int]]] = []
        at: dict[tuple[int, int], list[int]] = {}
        for k, (t, sentence, _) in enumerate(lines):
            if last >= 0 and k in (first, last):
                out.append((GAP, 1, 0, 0, [k]))
            if t is None:
                continue
            stretch = int(sentence) if last < 0 else 0 if k <= first else 1 + (k >= last)
            if (t, stretch) in at:
                at[t, stretch].append(k)
            else:
                at[t, stretch] = [k]
                out.append((t, int(stretch == 1), int(k < EDGE[0] or k >= len(lines) - EDGE[1]), int(not sentence), at[t, stretch]))
        return out

    @classmethod
    def stream(cls, lines: list[tuple[int | None, bool, bool]], frame: set[int]) -> Wrapper:
        """A page as a wrapper of its own, with gaps for its text."""
        stands = cls.stands(lines, frame)
        times = Counter(t for t, *_ in stands)
        return [[t, 1, inside, edge, int(times[t] > 1), len(at), bare] for t, inside, edge, bare, at in stands]

    def wrapper(self) -> Wrapper:
        same = Counter(tuple(map(tuple, self.stream(s, self.frame))) for s in self.streams)
        out: Wrapper = []
        for stream, n in sorted(same.items(), key=lambda x: (-x[1], x[0])):
            out = align(out, [[t, k * n, inside * n, edge * n, again * n, *e] for t, k, inside, edge, again, *e in stream])
        return out


_WRAPPER = "site string, part long, pages long, tokens array<long>, counts array<long>, inside array<long>, edge array<long>, again array<long>, times array<long>, bare array<long>"
_COLUMNS = ("tokens", "counts", "inside", "edge", "again", "times", "bare")


def _fold_pages(rows: pa.Table) -> pa.Table:
    """A partial wrapper of some pages of one site."""
    site, part = rows["site"][0].as_py(), rows["part"][0].as_py()
    pages: dict[int, list[tuple[int, list]]] = {}
    for page, uid, names, sizes, kinds in zip(*(rows[c].to_pylist() for c in ("page", "uid", "names", "sizes", "kinds"))):
        at, stream = 0, []
        for size, k in zip(sizes, kinds):
            if size:
                stream.append((tuple(names[at : at + size]), bool(k & 1), bool(k & 2)))
            at += size
        pages.setdefault(page, []).append((uid, stream))
    return _table([(site, part, len(pages), Part([[x for _, stream in sorted(c) for x in stream] for c in pages.values()]).wrapper())])


def _merge_wrappers(rows: pa.Table) -> pa.Table:
    wrapper: Wrapper = []
    for columns in sorted(zip(*(rows[c].to_pylist() for c in _COLUMNS)), key=lambda r: (-len(r[0]), r[0])):
        wrapper = align(wrapper, [list(e) for e in zip(*columns)])
    return _table([(rows["site"][0].as_py(), rows["part"][0].as_py() // MERGED, sum(rows["pages"].to_pylist()), wrapper)])


def _table(rows: list[tuple[str, int, int, Wrapper]]) -> pa.Table:
    column = lambda i: pa.array([[e[i] for e in w] for *_, w in rows], pa.list_(pa.int64()))
    return pa.table({"site": pa.array([r[0] for r in rows], pa.string()), "part": pa.array([r[1] for r in rows], pa.int64()), "pages": pa.array([r[2] for r in rows], pa.int64())} | {c: column(i) for i, c in enumerate(_COLUMNS)})


@lru_cache(maxsize=1 << 16)
def _line(line: str, site: str) -> tuple[tuple[int, ...], int]:
    """Names of a line's tokens, and 1 for a sentence plus 2 for over four words."""
    f = forms(line, site)
    return tuple(named(site, t) for t in f), (is_sentence(normal(line)[0]) + 2 * (f[0].count(" ") > 3)) if f else 0


_TOKENS = "uid long, page long, site string, names array<long>, sizes array<int>, kinds array<int>, cues array<int>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as streams: the tokens of each line by name and how many there are; and the lines that cues take for the frame's."""
    for batch in batches:
        names, sizes, kinds, cues, n_lines, n_names = [], [], [], [], [0], [0]
        for site, first, text in zip(*(c.to_pylist() for c in batch.columns[2:])):
            lines = _REPAIR.text(text)[0].split("\n")
            cues.append(places(lines, first))
            for f, k in [_line(x, site) for x in lines] if site else ():
                names += f
                sizes.append(len(f))
                kinds.append(k)
            n_lines.append(len(sizes))
            n_names.append(len(names))
        of_line = lambda x: pa.ListArray.from_arrays(pa.array(n_lines, pa.int32()), pa.array(x, pa.int32()))
        lists = [pa.ListArray.from_arrays(pa.array(n_names, pa.int32()), pa.array(names, pa.int64())), of_line(sizes), of_line(kinds), pa.array(cues, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["uid", "page", "site", "names", "sizes", "kinds", "cues"])


def token_streams(chunks: DataFrame) -> DataFrame:
    """One row a chunk: its page, its site, its lines' tokens and cues. Repeated chunks count once; null ids and texts give none."""
    rows = chunks.filter("uid is not null and text is not null").select("uid", "url", "text")
    one = materialize(rows.groupBy("uid").agg(F.max(F.struct("url", "text")).alias("c")).select("uid", "c.url", "c.text"), "p5-chunks")
    starts = one.filter("url is not null").groupBy(F.xxhash64("url").alias("page")).agg(F.min("uid").alias("head"))
    # chunks without url are pages of their own
    paged = one.withColumn("page", F.when(F.col("url").isNull(), F.col("uid")).otherwise(F.xxhash64("url")))
    first = F.col("url").isNull() | (F.col("uid") == F.col("head"))
    placed = paged.join(starts, "page", "left").select("uid", "page", site_of(F.col("url")).alias("site"), first.alias("first"), "text")
    return materialize(placed.mapInArrow(_tokens, _TOKENS), "p5-tokens")


def site_parts(streams: DataFrame) -> DataFrame:
    """``site, parts, n_rows``: into how many parts of about ``PART`` pages each site is cut."""
    rows = streams.filter("site is not null")
    return materialize(rows.groupBy("site").agg(F.ceil(F.approx_count_distinct("page") / PART).cast("long").alias("parts"), F.count(F.lit(1)).alias("n_rows")), "p5-sites")


def _placed(streams: DataFrame, sites: DataFrame) -> DataFrame:
    rows = streams.filter("site is not null")
    return skew_lookup(rows, sites, "site", "n_rows", F.col("page")).withColumn("part", F.pmod(F.xxhash64("page"), F.col("parts"))).drop("parts")


def wrappers(streams: DataFrame, sites: DataFrame) -> DataFrame:
    """``site, pages, tokens, counts, inside, edge, again, times, bare``: of ``token_streams`` the wrapper of each site.

    A site of any size is folded in parallel, by its ``site_parts``; partial wrappers are merged ``MERGED`` at a time until
    there is one of each site.
    """
    placed = _placed(streams.drop("cues"), sites)
    found = materialize(placed.groupBy("site", "part").applyInArrow(_fold_pages, _WRAPPER), "p5-wrappers")
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        found = materialize(found.groupBy("site", F.floor(F.col("part") / MERGED)).applyInArrow(_merge_wrappers, _WRAPPER), "p5-wrappers")
    return found.drop("part")


class Matcher:
    """Looks lines of pages up in their site's wrapper."""

    def __init__(self, wrapper: Wrapper, pages: int) -> None:
        self.places = judged(wrapper, pages)
        by_token: dict[int, Counter] = {}
        for e, what in zip(wrapper, self.places):
            by_token.setdefault(e[0], Counter())[what] += e[1]
        self.known = set(by_token)
        #: tokens that are the frame's in some place, those that aren't in every one, and of these the ones that mostly are
        self.some = {t for t, c in by_token.items() if c[BESIDE] or c[SURE]}
        self.mixed = {t for t in self.some if by_token[t][SURE] < by_token[t].total()}
        self.usual = {t for t in self.mixed if by_token[t][SURE] * 2 >= by_token[t].total()}
        self.aligner = SequenceMatcher(None, [], [e[0] for e in wrapper], autojunk=False)

    def _token(self, f: tuple[int, ...]) -> int | None:
        return next((t for t in f if t in self.some), next((t for t in f if t in self.known), None))

    def lines(self, page: list[tuple[tuple[int, ...], bool, bool]]) -> list[bool]:
        """Of each line of a page whether it is the frame's; a line's forms as in ``Part``.

        Only pages with tokens that aren't the frame's in every place have to be aligned. A token that falls on no place
        is what it mostly is. On a copy of another page, without text of its own, and of lines long enough for a sentence
        or title only what is sure counts.
        """
        out = [any(t in self.some and t not in self.mixed for t in f) for f, *_ in page]
        if not self.mixed or all(x or self.mixed.isdisjoint(f) for x, (f, *_) in zip(out, page)):
            return out
        lines = [(self._token(f), *x) for f, *x in page]
        own = any(t is None and long for t, _, long in lines)
        stands = Part.stands(lines, self.some)
        self.aligner.set_seq1([t for t, *_ in stands])
        place = {i + d: self.places[j + d] for i, j, n in self.aligner.get_matching_blocks() for d in range(n)}
        for i, (t, *_, at) in enumerate(stands):
            if t in self.mixed:
                what = place.get(i, SURE if t in self.usual else UNKNOWN)
                for k in at:
                    out[k] |= what == SURE or what == BESIDE and own and not lines[k][2]
        return out


_FRAME_LINES = "uid long, line_no int, by_wrapper boolean"


def _match_pages(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The frame's lines on some pages of one site, by its wrapper and by cues."""
    columns = [found[c][0].as_py() for c in _COLUMNS] if len(found) else [()]
    matcher = Matcher([list(e) for e in zip(*columns)], found["pages"][0].as_py() if len(found) else 0)
    rows = rows.combine_chunks().sort_by([("page", "ascending"), ("uid", "ascending")])
    flat = {c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in rows[c].chunks] or [np.zeros(0, np.int64)]) for c in ("names", "sizes", "kinds", "cues")}
    count = {c: pc.list_value_length(rows[c]).to_numpy().astype(np.int64) for c in ("sizes", "cues")}
    # of each line: its chunk, its number, and where its names begin and end
    begin = np.cumsum(count["sizes"]) - count["sizes"]
    chunk = np.repeat(np.arange(len(rows)), count["sizes"])
    ends = np.cumsum(flat["sizes"], dtype=np.int64)
    starts = ends - flat["sizes"]

    def having(tokens: set[int]) -> np.ndarray:
        n = np.concatenate([[0], np.cumsum(np.isin(flat["names"], np.fromiter(tokens, np.int64, len(tokens))))])
        return n[ends] > n[starts]

    own = having(matcher.some - matcher.mixed)
    page = rows["page"].to_numpy()[chunk]
    # only pages with tokens of unlike places are aligned
    for p in np.unique(page[having(matcher.mixed)]).tolist():
        at = np.flatnonzero((page == p) & (flat["sizes"] > 0))
        own[at] = matcher.lines([(tuple(flat["names"][starts[i] : ends[i]].tolist()), bool(flat["kinds"][i] & 1), bool(flat["kinds"][i] & 2)) for i in at])
    every = own.copy()
    every[np.repeat(begin, count["cues"]) + flat["cues"]] = True
    kept = np.flatnonzero(every)
    uids, numbers = rows["uid"].to_numpy()[chunk[kept]], kept - begin[chunk[kept]]
    return pa.table([pa.array(uids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(own[kept], pa.bool_())], ["uid", "line_no", "by_wrapper"])


def frame_lines(chunks: DataFrame) -> DataFrame:
    """``uid, line_no, by_wrapper`` of each line that isn't the article's; ``chunks`` has ``uid, url, text``.

    ``by_wrapper`` is false for lines that cues alone tell. Empty lines are of neither kind and give no rows, nor do null
    texts and ids. A chunk without url is judged by cues alone. Wrongly decoded lines are judged as what they were.
    Repeated chunks count once; an empty table gives no rows.
    """
    streams = token_streams(chunks)
    sites = site_parts(streams)
    # a site's wrapper once for each part of its pages
    each = wrappers(streams, sites).join(sites, "site").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts", "n_rows")
    by_wrapper = _placed(streams, sites).groupBy("site", "part").cogroup(each.groupBy("site", "part")).applyInArrow(_match_pages, _FRAME_LINES)
    by_cue = streams.filter("site is null").select("uid", F.explode("cues").alias("line_no"), F.lit(False).alias("by_wrapper"))
    return by_wrapper.unionByName(by_cue)


def boilerplate(chunks: DataFrame) -> DataFrame:
    """``uid, line_no`` of ``frame_lines``."""
    return frame_lines(chunks).select("uid", "line_no")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate(chunk_rows(spark, sf))


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = {named(site, t): t for site, text in zip(*(c.to_pylist() for c in batch.columns)) for x in _REPAIR.text(text)[0].split("\n") for t in forms(x, site)}
        yield pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.int64()), pa.array(known.values(), pa.string())], ["h", "token"])


def spelled_wrappers(chunks: DataFrame) -> DataFrame:
    """``site, pages, wrapper``: each site's wrapper as a regular expression of tokens, a line each, optional ones with
    ``?`` and repeated ones with ``+``."""
    streams = token_streams(chunks)
    found = materialize(wrappers(streams, site_parts(streams)), "p5-wrapper")
    each = found.select("site", "pages", F.posexplode(F.arrays_zip("tokens", "counts", "times")).alias("at", "e")).select("site", "pages", "at", F.col("e.tokens").alias("h"), "e.counts", "e.times")
    sited = chunks.filter("uid is not null and text is not null").select(site_of(F.col("url")).alias("site"), "text").filter("site is not null")
    words = sited.mapInArrow(_spelled, "h long, token string").join(each.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("token").alias("token"))
    line = F.concat("token", F.when(F.col("times") > 1, "+").otherwise(""), F.when(F.col("counts") < F.col("pages"), "?").otherwise(""))
    return each.join(words, "h").groupBy("site", "pages").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).getField("line"), "\n").alias("wrapper"))


def p5_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    return spelled_wrappers(chunk_rows(spark, sf))


QUERIES = {"p5_found": p5_found, "p5_wrappers": p5_wrappers}
ORACLE: dict[str, str] = {}
