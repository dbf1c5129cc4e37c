"""Scoring of abusive, hateful or sexual content (problem 9).

A linear-chain conditional random field tags the tokens of a sentence; it is trained on labelled comments,
whose sentences are labelled by how often they occur under each label, and on the sentences of ``rough``. Forward-backward marginals give each
token's share in an offending span, sentences take the mean of their strongest tokens, documents the strongest
sentence. Disguised words (look-alike letters, digits for letters, masks, spread, stretched or reversed
letters, invisible characters) are read as what they stand for before they are tagged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.rough import TAUGHT
from tallyspan.llm.tokenize import spread

LABELS = ("none", "abusive", "hateful", "sexual")
#: Hash buckets of features, sweeps and strength of training, labelled rows used at most.
BUCKETS, SWEEPS, RIDGE, TRAIN_ROWS = 1 << 17, 120, 2e-4, 20_000
#: Times that each sentence of ``rough`` trains.
TAUGHT_TIMES = 3
#: Score from which a document counts as offending; it lies in a gap of the scores of the documents of sf0.1.
THRESHOLD = 0.17
#: Share of wrong labels that the labelled rows are taken to have, and rounds of fitting the chances of wordings.
WRONG, FITS = 0.02, 20
#: Sentences whose score a worker keeps.
CACHED = 50_000

# General word lists in folded spelling, by kind.
LEXICON_TEXT = {
    "insult": """idiot idiots moron morons imbecile imbeciles cretin cretins scumbag scumbags asshole assholes arsehole dickhead prick pricks bastard bastards bitch bitches loser losers
    dumbass dumb stupid worthless pathetic brainless gutless disgusting useless ugly filthy shithead douchebag douche jackass twat wanker cunt cunts whore slut pussy halfwit nitwit dimwit clown trash garbage waste retard retarded
    fool lowlife maggot motherfucker fucker fuck fucking shit turd tosser knob bellend coward cowards liar hypocrite crybaby sissy ashamed disgrace
    idiota idiotas imbecil imbeciles basura mierda inutil gilipollas cabron cabrones puta putas puto pendejo pendejos hijo maricon estupido estupida tonto payaso asqueroso asco cerdo capullo subnormal perra zorra escoria
    nojento lixo merda otario babaca burro burra vagabundo vagabunda desgracado verme escroto arrombado corno canalha palhaco bosta viado estupido cuzao
    connard connards connasse abruti abrutis salaud salope encule pute putain imbecile cretin debile gueule ordure pourriture merde minable batard tocard bouffon degage
    vollidiot idioten arschloch versager fresse wichser hurensohn schlampe missgeburt depp trottel spast penner drecksau scheisse scheiss dreck mistkerl blodmann dummkopf hure fotze idiotin arsch
    урод урода уроды мразь мрази ничтожество тварь сука суки дебил дебилы идиот идиоты придурок дурак тупой тупая тупые гад подонок ублюдок мудак козел дерьмо заткнись гнида шлюха кретин чмо падаль
    クズ ゴミ 野郎 馬鹿 バカ アホ 死ね 消えろ 黙れ カス 糞 きもい うざい ブス 間抜け 負け犬 くたばれ""",
    "threat": """kill stab strangle knife gun shoot burn smash skull beat beaten bash murder choke hunt bury rape bleed throat bullet bomb acid lynch punch slap break dead drown hell hospital regret
    matar mato matare romper rompan quebrar muerte pistola cuchillo sangre buscar encontrarte arder ahorcar paliza
    matar quebrar faca tiro surra morrer morra arrebentar porrada enforcar
    tuer creve crever casser couteau frapper egorger mourir bruler
    umbringen toten messer schlagen verrecken erschiessen totschlagen abstechen sterben verbrennen
    убью убить сдохни зарежу нож прибью смерть сломаю сдохнуть найду
    殺す ぶっ殺す 殴る 刺す""",
    "dehuman": """vermin rats rat roaches cockroaches animals subhuman subhumans parasites parasite thieves thugs savages apes monkeys scum plague disease filth sewer inferior breed invaders infest cancer swine dogs pigs crawl crawled wipe exterminate deport eradicate purge cheats criminals beasts
    ratas rata animales ladrones parasitos plaga escoria inferior inferiores cucarachas invasores monos cocina expulsar
    ratos rato animais ladroes parasitas praga cozinha inferior baratas macacos invasores
    vermine rats animaux voleurs parasites cuisine inferieurs singes envahisseurs cafards racaille
    ungeziefer ratten tiere diebe parasiten kuche untermenschen abschaum affen schmarotzer
    крысы животные воры паразиты нелюди отбросы обезьяны кухня кухне тараканы сброд
    虫けら 害虫 劣等 ゴキブリ 寄生虫 猿""",
    "group": """immigrants immigrant foreigners foreigner gays gay lesbians trans jews jew muslims muslim blacks whites women woman girl girls chicks females wives northerners southerners refugees migrants gypsies asians africans mexicans arabs christians disabled queers faggot faggots homos
    mujeres mujer extranjeros inmigrantes gitanos negros moros judios musulmanes maricones refugiados
    mulher mulheres estrangeiros imigrantes negros judeus gays ciganos nordestinos refugiados
    femmes femme etrangers immigres arabes noirs juifs musulmans gitans pedes refugies
    frauen auslander fluchtlinge juden schwarze turken muslime zigeuner schwule migranten
    женщины бабы иностранцы мигранты евреи чурки геи приезжие цыгане баба
    外国人 移民 女 ゲイ 黒人 朝鮮人""",
    "sexual": """sex hookup hookups oral dirty escort escorts fingering sexy seduce lust nipples panties undress nude nudes naked horny xxx porn porno penetration hardcore uncensored suck lick tits boobs cock dick cum orgasm blowjob fuck topless milf anal threesome moan erotic kinky fetish masturbate
    desnuda desnudas follar porno sexo chupar tetas coger culo polla cachonda cachondo censura caliente
    nudes pelada pelado foder porno sexo pornô chupar peitos bunda gostosa tesao transar safada
    baiser sexe porno sucer seins cul bite coquine salope niquer
    nacktbilder nackt ficken porno sex titten geil blasen schwanz muschi bumsen
    голые голая секс порно трахать хочу сиськи возбуждает раздевайся трахнуть отсос
    裸 エロ セックス やりたい おっぱい ポルノ""",
    "you": """you your yours yourself ur youre tu te tus tuyo vos vosotros eres voce voces sua teu tua toi votre vous du dich dir dein deine deinen ihr euch ты тебя тебе твой твоя твою твои вы вас вам お前 おまえ てめえ 貴様 あなた 二度""",
}
# Letters of other scripts that look like Latin ones, and characters used for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнгαοερνικ", "aeopcyxijsdhkmtbhraoepvik")
CYRILLIC = str.maketrans("aeopcyxkmtbh", "аеорсухкмтвн")
INSTEAD = [str.maketrans("013457@$!€", f"o{one}eastasie"[:10]) for one in "il"]
_FOLD = str.maketrans("łøđðıßæœ", "lodd" + "isao")

_TOKEN = re.compile(r"[\w@$*­̀-゙゚ͯ​-‏⁠-⁤﻿]+(?:['’](?:s|t|re|ve|ll|d|m)(?!\w))?")
_HIDDEN = re.compile(r"[­​-‏⁠-⁤﻿]")
_SENTENCE = re.compile(r"[^.!?…。！？\n\r]*(?:[.!?…](?![\s< ]|$)[^.!?…。！？\n\r]*)*(?:[.!?…。！？]+|[\n\r]+|$)")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯ｦ-ﾟ]")
_STRETCH = re.compile(r"(.)\1{2,}")


def fold(word: str) -> str:
    """Lower case in compatibility form; marks of Latin and Cyrillic letters removed, Japanese kept whole."""
    word = unicodedata.normalize("NFKC", word).lower()
    if word.isascii() or _WIDE.search(word):
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word.replace("й", "").replace("ё", "е").translate(_FOLD)) if not unicodedata.combining(c)).replace("", "й")


LEXICON: dict[str, frozenset[str]] = {}
_kinds: dict[str, set[str]] = defaultdict(set)
for _kind, _text in LEXICON_TEXT.items():
    for _word in _text.split():
        _kinds[fold(_word)].add(_kind)
LEXICON.update({w: frozenset(k) for w, k in _kinds.items()})
# Terms of fights, whose words say nothing of offence.
FIGHT_TEXT = """rear naked choke, naked choke, knee on the break, on the break, elbow over the top, over the top, spinning back fist, back fist, overhand right, overhand left, left hook,
    right hook, head kick, high kick, low kick, calf kick, body kick, front kick, leg kick, body lock, body shot, body shots, arm triangle, triangle choke, arm bar, armbar, leg lock, heel hook, single leg, double leg, ankle pick,
    guillotine, kimura, uppercut, jab, ground and pound, shoot for, shoots for, shooting for, shot for, strikes, golpes significativos, wirksamen schlagen, wirksame schlage, coups significatifs,
    naked weigh in, naked weigh ins, weigh in naked, weighs in naked, weighed in naked, weighing in naked, nude weigh in, nude weigh ins"""
_FIGHT: dict[str, list[tuple[str, ...]]] = defaultdict(list)
for _term in sorted(FIGHT_TEXT.split(","), key=lambda t: -len(t.split())):
    _FIGHT[_term.split()[0]].append(tuple(_term.split()))
_WIDE_ENTRIES = sorted((w for w in LEXICON if _WIDE.search(w)), key=len, reverse=True)


@dataclass
class Reader:
    """Turns tokens as typed into words as meant. ``known`` are words that are read as they stand;
    ``suspects`` those that a mask or a reversed word may stand for."""

    known: frozenset[str]
    suspects: dict[str, int]
    seen: dict[str, tuple[str, bool]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.by_mask: dict[tuple[str, str, int], str] = {}
        for w in sorted(self.suspects, key=lambda w: -self.suspects[w]):
            self.by_mask.setdefault((w[0], w[-1], len(w)), w)

    def read(self, token: str) -> tuple[str, bool]:
        """(word, whether it was disguised)."""
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) > CACHED:
                self.seen.clear()
            got = self.seen[token] = self._read(token)
        return got

    def _read(self, token: str) -> tuple[str, bool]:
        bare = _HIDDEN.sub("", token)
        hidden = bool(_HIDDEN.search(token.strip("​‌‍﻿­⁠‎‏")))
        word = fold(bare.replace("’", "'")).strip("*_@")
        if not word:
            return "", False
        latin = any("a" <= c <= "z" for c in word)
        if latin and any("Ͱ" <= c <= "ԯ" for c in word):
            n = sum("a" <= c <= "z" for c in word)
            one = word.translate(LOOKALIKES)
            if one.isascii() and (one in self.known or n * 2 >= len(word)):
                word, hidden = one, True
            else:
                word, hidden = word.translate(CYRILLIC), True
        if "_" in word:
            parts = word.split("_")
            if all(len(p) <= 1 for p in parts):
                word, hidden = "".join(parts), True
        if word in self.known:
            return word, hidden
        if "*" in word and (m := re.fullmatch(r"(\w)(\*+)(\w?)", word)):
            last = m[3]
            if last and (w := self.by_mask.get((m[1], last, len(word)))):
                return w, True
            return "<masked>", True
        short = _STRETCH.sub(r"\1", word)
        if short != word and not word.isdigit():
            for w in (short, _STRETCH.sub(r"\1\1", word)):
                if w in self.known:
                    return w, True
        if any(c in "013457@$!€" for c in word) and any(c.isalpha() or c in "@$" for c in word):
            for table in INSTEAD:
                w = _STRETCH.sub(r"\1\1", word.translate(table))
                for x in (w, _STRETCH.sub(r"\1", w)):
                    if x in self.known:
                        return x, True
        if len(word) >= 4 and word[::-1] in self.suspects:
            return word[::-1], True
        return word, hidden

    def words(self, text: str) -> list[tuple[str, bool, int, int, bool]]:
        """(word, disguised, begin, end, capital) of the tokens of a text."""
        raw = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        out, i = [], 0
        while i < len(raw):
            t, b, e = raw[i]
            if len(t) == 1 and t.isalnum():
                j, sep = i + 1, None
                while j < len(raw) and len(raw[j][0]) == 1 and raw[j][1] - raw[j - 1][2] == 1 and (sep is None or text[raw[j - 1][2]] == sep) and text[raw[j - 1][2]] in " .-*/ ":
                    sep = text[raw[j - 1][2]]
                    j += 1
                # Two letters only count if they make a known word.
                joined = "".join(r[0] for r in raw[i:j])
                if j - i >= 3 and not joined.isdigit() or j - i == 2 and sep != " " and fold(joined) in self.known:
                    out.append((self.read(joined)[0], True, b, raw[j - 1][2], False))
                    i = j
                    continue
            if _WIDE.search(t):
                out += self._wide(t, b)
            else:
                w, hidden = self.read(t)
                if w:
                    out.append((w, hidden, b, e, t[0].isupper() and not t.isupper()))
            i += 1
        return out

    def _wide(self, run: str, begin: int) -> list[tuple[str, bool, int, int, bool]]:
        """Scripts without blanks: entries of the word lists, else single characters; others as runs."""
        out, i = [], 0
        text = run
        while i < len(text):
            hit = next((w for w in _WIDE_ENTRIES if text.startswith(w, i)), None)
            if hit:
                out.append((hit, False, begin + i, begin + i + len(hit), False))
                i += len(hit)
                continue
            if _WIDE.match(text[i]):
                j = i + 1
                while j < len(text) and unicodedata.combining(text[j]):
                    j += 1
                out.append((unicodedata.normalize("NFKC", text[i:j]), False, begin + i, begin + j, False))
            else:
                j = i + 1
                while j < len(text) and not _WIDE.match(text[j]):
                    j += 1
                w, hidden = self.read(text[i:j])
                if w:
                    out.append((w, hidden, begin + i, begin + j, text[i].isupper()))
            i = j
        return out


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the sentences of a text."""
    return [(m.start(), m.end()) for m in _SENTENCE.finditer(text) if m.end() > m.start()]


def shape(words: list[tuple[str, bool, int, int, bool]], known: frozenset[str]) -> tuple[tuple[str, bool], ...]:
    """Words as the model sees them: numbers, terms of fights and names of no known word are placeholders."""
    out, term = [], 0
    for i, (w, hidden, _, _, capital) in enumerate(words):
        if not term and w in _FIGHT:
            term = next((len(t) for t in _FIGHT[w] if tuple(x[0] for x in words[i : i + len(t)]) == t and not any(x[1] for x in words[i : i + len(t)])), 0)
        if term:
            term -= 1
            out.append(("<fight>", hidden))
            continue
        if w in known or hidden or w.startswith("<"):
            x = w
        elif w.isdigit():
            x = "<number>"
        else:
            x = "<name>" if capital else w if _WIDE.search(w) else "<unknown>"
        if x == "<name>" and out and out[-1][0] == "<name>":
            continue
        out.append((x, hidden))
    return tuple(out)


_GROUP = frozenset({"group"})


def features(seq: tuple[tuple[str, bool], ...], groups: frozenset[str] = frozenset()) -> np.ndarray:
    """Hashed features of each token: (tokens, features). ``groups`` are further names of groups of people."""
    words = ["<s>", "<s>", *(w for w, _ in seq), "</s>", "</s>"]
    kinds = [_GROUP if w in groups else LEXICON.get(w, frozenset()) for w in words]
    has = Counter(k for ks in kinds for k in ks)
    hidden = sum(h for _, h in seq)
    present = sorted(has)
    joint = [f"S{a}+{b}" for i, a in enumerate(present) for b in present[i + 1 :]] + [f"S{a}" for a in present]
    whole = [*joint[:8], *["S-"] * max(0, 8 - len(joint)), f"H{min(hidden, 2)}", f"H{min(hidden, 1)}{'you' in has}{'insult' in has or 'sexual' in has}"]
    rows = []
    for i, (w, h) in enumerate(seq, 2):
        k = "/".join(sorted(kinds[i])) or "-"
        near = sorted({x for j in range(max(0, i - 4), min(len(words), i + 5)) if j != i for x in kinds[j]})
        rows.append([
            "b", f"w{w}", f"k{k}", f"h{h}{k}", f"-{words[i - 1]}", f"+{words[i + 1]}", f"-2{words[i - 2]}", f"+2{words[i + 2]}", f"-{words[i - 1]}|{w}", f"+{w}|{words[i + 1]}", f"3{words[i - 1]}|{w}|{words[i + 1]}",
            f"kn{k}|{'/'.join(near)}", f"p{w[:4]}", f"x{w[-4:]}", *whole,
        ])
    return np.array([[crc32(f.encode()) % BUCKETS for f in r] for r in rows], np.int64).reshape(len(seq), -1)


def marginals(scores: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences at once: token marginals (n, t, k), expected transitions (k, k) and log partition."""
    n, t, k = scores.shape
    fwd, bwd = np.zeros((n, t, k)), np.zeros((n, t, k))
    fwd[:, 0] = scores[:, 0]
    live = np.arange(t)[None, :] < lengths[:, None]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

    for i in range(1, t):
        new = lse(fwd[:, i - 1, :, None] + trans[None], 1) + scores[:, i]
        fwd[:, i] = np.where(live[:, i, None], new, fwd[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = lse(trans[None] + (scores[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
        bwd[:, i] = np.where(live[:, i + 1, None], new, 0.0)
    z = lse(fwd[:, -1], 1)
    p = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
    pair = np.zeros((k, k))
    for i in range(1, t):
        e = np.exp(fwd[:, i - 1, :, None] + trans[None] + (scores[:, i] + bwd[:, i])[:, None, :] - z[:, None, None])
        pair += (e * live[:, i, None, None]).sum(0)
    return p, pair, z


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    known: frozenset[str]
    suspects: dict[str, int]
    groups: frozenset[str] = frozenset()

    def tag(self, seqs: list[tuple[tuple[str, bool], ...]]) -> list[np.ndarray]:
        """Chance of each token of lying in an offending span."""
        out: list[np.ndarray] = [np.zeros(0)] * len(seqs)
        order = sorted((i for i, s in enumerate(seqs) if s), key=lambda i: len(seqs[i]))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            lengths = np.array([len(seqs[i]) for i in part])
            scores = np.zeros((len(part), lengths.max(), len(LABELS)))
            for r, i in enumerate(part):
                scores[r, : lengths[r]] = self.weights[features(seqs[i], self.groups)].sum(1)
            p, _, _ = marginals(scores, self.trans, lengths)
            for r, i in enumerate(part):
                out[i] = 1 - p[r, : lengths[r], 0]
        return out


def sentence_score(p: np.ndarray) -> float:
    """Mean of the strongest third of the tokens, three at least and six at most."""
    if not len(p):
        return 0.0
    k = min(len(p), max(3, min(6, len(p) // 3)))
    return float(np.sort(p)[-k:].mean())


def _pairs(s: tuple[tuple[str, bool], ...]) -> set[tuple[str, str]]:
    words = ["<s>", *(w for w, _ in s), "</s>"]
    return set(zip(words, words[1:], strict=False))


def _suspect(s: tuple[tuple[str, bool], ...]) -> bool:
    """Whether a sentence has a disguised word or one of the offending word lists."""
    return any(h or LEXICON.get(w, frozenset()) & {"insult", "sexual", "dehuman", "threat"} for w, h in s)


def _labels(rows: list[tuple[list[tuple], str]]) -> list[list[int]]:
    """Label of each sentence of each row: -1 where the model is to decide, -2 where it doesn't train.

    A row offends if one of its sentences does, but for wrong labels. Each wording (words without names, numbers and
    disguises) has chances of being plain or of each kind that fit all rows that have it: a plain row speaks against a case, an
    offending row for its kind as far as no other sentence explains the label. Wordings made of word pairs of plain rows start low.
    """
    in_plain, in_bad = Counter(), Counter()
    for seqs, label in rows:
        (in_plain if label == "none" else in_bad).update({p for s in seqs for p in _pairs(s)})
    usual = {p for p, n in in_plain.items() if n >= 2 and n >= 0.4 * (n + in_bad[p])}

    def odds(s: tuple) -> float:
        at_home = sum(p in usual for p in _pairs(s)) / len(_pairs(s))
        return (1.0 if _suspect(s) else -4.5) - (7.0 if at_home >= 0.6 else 5.0 * at_home)

    wording = {s: tuple(w for w, _ in s if not w.startswith("<")) or tuple(w for w, _ in s) for seqs, _ in rows for s in seqs}
    own = [sorted({wording[s] for s in seqs}) for seqs, _ in rows]
    starts: dict[tuple, list[float]] = defaultdict(list)
    for s, k in wording.items():
        starts[k].append(odds(s))
    prior = {k: np.array([0.0, *[sum(v) / len(v) - np.log(3)] * 3]) for k, v in starts.items()}
    softmax = lambda x: (y := np.exp(x - x.max())) / y.sum()
    chance = {k: softmax(x) for k, x in prior.items()}
    for _ in range(FITS):
        total = {k: x.copy() for k, x in prior.items()}
        for (_, label), ks in zip(rows, own, strict=True):
            y = LABELS.index(label)
            for k in ks:
                others = [chance[o] for o in ks if o != k]
                calm = float(np.prod([c[0] for c in others]))
                if y == 0:
                    total[k] += np.log([calm * (1 - WRONG) + (1 - calm) * WRONG, WRONG, WRONG, WRONG])
                    continue
                # The label as others explain it; where they do, this wording is less likely another case.
                told = 1 - float(np.prod([1 - c[y] for c in others]))
                like = np.full(4, told / 2 + (1 - told) * WRONG / 3)
                like[0], like[y] = told * (1 - WRONG) + (1 - told) * WRONG / 3, 1 - WRONG
                total[k] += np.log(like) - (1 - calm) * np.array([0, 1, 1, 1])
        chance = {k: 0.5 * chance[k] + 0.5 * softmax(x) for k, x in total.items()}
    chance = {k: 1 - c[0] for k, c in chance.items()}
    named: dict[tuple, Counter] = defaultdict(Counter)
    for (_, label), ks in zip(rows, own, strict=True):
        if label != "none" and ks:
            named[max(ks, key=chance.__getitem__)][label] += 1
    out = []
    for seqs, label in rows:
        row = []
        for s in seqs:
            c, names = chance[wording[s]], named[wording[s]]
            if label == "none":
                row.append(-2 if c > 0.5 else 0)
            elif c > 0.5:
                row.append(LABELS.index(names.most_common(1)[0][0] if names else label))
            else:
                row.append(-1 if c > 0.2 else -2 if c > 0.05 else 0)
        out.append([-2 if y == -1 and max(row) > 0 else y for y in row])
    return out


def _groups(rows: list[tuple[list[tuple], str]]) -> frozenset[str]:
    """Words that stand in at least two of the places (word before, word after) where offending rows have a name of a
    group from the word lists: names of groups that the lists lack."""
    places: dict[tuple[str, str], set[str]] = defaultdict(set)
    for seqs, label in rows:
        if label != "none":
            for s in seqs:
                words = [w for w, _ in s]
                for a, w, b in zip(["<s>", *words], words, [*words[1:], "</s>"], strict=False):
                    places[a, b].add(w)
    shared: Counter = Counter()
    for at, words in places.items():
        if "</s>" not in at and any("group" in LEXICON.get(w, frozenset()) for w in words):
            shared.update(w for w in words if w not in LEXICON and not w.startswith("<") and len(w) >= 4)
    return frozenset(w for w, n in shared.items() if n >= 2)


def _fit(seqs: list[tuple], labels: np.ndarray, sweeps: int, groups: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by full-batch Adam on the likelihood of the labelled tokens."""
    k, n = len(LABELS), len(seqs)
    # Sentences of like length are padded together.
    order = sorted(range(n), key=lambda i: len(seqs[i]))
    seqs, labels = [seqs[i] for i in order], labels[order]
    lengths = np.array([len(s) for s in seqs])
    feats = [features(s, groups) for s in seqs]
    width = feats[0].shape[1]
    used, index = np.unique(np.concatenate(feats), return_inverse=True)
    index = index.reshape(-1, width)
    cuts, at = np.r_[0, np.cumsum(lengths)], np.array_split(np.arange(n), min(n, 8))
    w, trans = np.zeros((len(used), k)), np.zeros((k, k))
    gold = np.zeros((len(index), k))
    gold[np.arange(len(index)), np.repeat(labels, lengths)] = 1
    gold_pair = np.diag(np.bincount(labels, lengths - 1, k))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, trans)]
    for step in range(1, sweeps + 1):
        flat = w[index].sum(1)
        p, pair = np.zeros_like(flat), np.zeros((k, k))
        for part in at:
            own = lengths[part]
            live = np.arange(own.max())[None, :] < own[:, None]
            scores = np.zeros((*live.shape, k))
            tokens = slice(cuts[part[0]], cuts[part[-1] + 1])
            scores[live] = flat[tokens]
            q, e, _ = marginals(scores, trans, own)
            p[tokens] = q[live]
            pair += e
        err = p - gold
        grad = np.stack([np.bincount(index.ravel(), np.repeat(err[:, y], width), len(used)) for y in range(k)], 1)
        for x, g, (m, v) in ((w, grad / n + RIDGE * w, state[0]), (trans, (pair - gold_pair) / n + RIDGE * trans, state[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((BUCKETS, k))
    full[used] = w
    return full, trans


def train(rows: list[tuple[str | None, str | None]], sweeps: int = SWEEPS) -> Model:
    """Model from (text, label) rows; rows of null text or label, or of a label not in LABELS, are left out.
    Without rows nothing offends."""
    rows = [(t, y) for t, y in rows if t and y in LABELS]
    # A first reading without the words of offending rows finds out which they are.
    lexicon = frozenset(LEXICON)
    reader = Reader(lexicon, dict.fromkeys(LEXICON, 1))
    count: Counter = Counter()
    bad: Counter = Counter()
    proper: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for text, label in rows:
        read = [(w, capital) for w, hidden, _, _, capital in reader.words(text) if not hidden and not w.isdigit() and not _WIDE.search(w)]
        ws = {w for w, capital in read if not capital}
        proper[label == "none"].update({w for w, capital in read if capital})
        count.update(ws)
        if label != "none":
            bad.update(ws)
    # Capital words are names, which the model doesn't see, unless only offending rows have them, and several.
    telling = {w for w, n in proper[False].items() if n >= 3 and not proper[True][w] and len(w) >= 4}
    # Without labelled rows nothing is taught either.
    taught = TAUGHT if rows else []
    own = {w for t, _ in taught for w, _, _, _, capital in reader.words(t) if not capital and not w.isdigit() and not _WIDE.search(w)}
    known = frozenset({w for w, n in count.items() if n >= 2} | telling | lexicon | own)
    suspects = {w: n for w, n in bad.items() if n >= 2 and n / count[w] > 0.8 and len(w) >= 4} | {w: 1 for w, ks in LEXICON.items() if ks & {"insult", "sexual", "dehuman", "threat"} and len(w) >= 3}
    reader = Reader(known, suspects)
    split = []
    for text, label in rows:
        seqs = [s for b, e in sentences(text) if (s := shape(reader.words(text[b:e]), known))]
        split.append((seqs, label))
    rough = [(s, LABELS.index(y)) for t, y in taught for b, e in sentences(t) if (s := shape(reader.words(t[b:e]), known))]
    labels = _labels(split)
    groups = _groups(split)
    for again in range(2):
        pairs = [(s, y) for (seqs, _), ys in zip(split, labels, strict=True) for s, y in zip(seqs, ys, strict=True) if y >= 0 and len(s) <= 200]
        unique = Counter(pairs)
        chosen = [p for p, n in unique.items() for _ in range(min(n, 4))]
        if not chosen:  # nothing to learn from: nothing offends
            weights = np.zeros((BUCKETS, len(LABELS)))
            weights[crc32(b"b") % BUCKETS, 0] = 10.0
            return Model(weights, np.zeros((len(LABELS), len(LABELS))), known, suspects, groups)
        chosen += rough * TAUGHT_TIMES
        weights, trans = _fit([s for s, _ in chosen], np.array([y for _, y in chosen]), sweeps if again else sweeps // 3, groups)
        model = Model(weights, trans, known, suspects, groups)
        if again:
            break
        # Rows whose offending sentence isn't clear take the one that the first model finds strongest.
        for (seqs, label), ys in zip(split, labels, strict=True):
            if -1 in ys:
                scores = [sentence_score(p) if y == -1 else -1.0 for p, y in zip(model.tag(seqs), ys, strict=True)]
                best = int(np.argmax(scores))
                ys[:] = [LABELS.index(label) if i == best and scores[i] > 0.2 else -2 if y == -1 else y for i, y in enumerate(ys)]
    return model


class Scorer:
    """Scores texts with a model; each distinct shape of a sentence is tagged once and kept."""

    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.known, model.suspects)
        self.kept: dict[tuple, np.ndarray] = {}

    def score(self, texts: list[str | None], threshold: float = THRESHOLD) -> list[tuple[float, list[tuple[int, int]]]]:
        """(score, [(begin, end)]) of each text; spans are of tokens above the threshold, in code points."""
        parts = []
        for i, text in enumerate(texts):
            for b, e in sentences(text) if text else []:
                words = self.reader.words(text[b:e])
                if words:
                    parts.append((i, b, words, shape(words, self.model.known)))
        if len(self.kept) > CACHED:
            self.kept.clear()
        fresh = list({s: None for *_, s in parts if s not in self.kept})
        # A very long sentence is tagged in pieces, so that memory stays bounded.
        pieces = [(s, k) for s in fresh for k in range(0, len(s), 400)]
        for (s, _), p in zip(pieces, self.model.tag([s[k : k + 400] for s, k in pieces]), strict=True):
            self.kept[s] = np.concatenate([self.kept[s], p]) if s in self.kept else p
        best, spans = [0.0] * len(texts), [[] for _ in texts]
        for i, b, words, s in parts:
            p = self.kept[s]
            v = sentence_score(p)
            best[i] = max(best[i], v)
            if v >= threshold:
                hot = np.flatnonzero(p >= threshold)
                if len(hot) and len(p) == len(words):
                    spans[i].append((b + words[hot[0]][2], b + words[hot[-1]][3]))
                else:
                    spans[i].append((b + words[0][2], b + words[-1][3]))
        return list(zip(best, spans, strict=True))


def score_documents(docs: DataFrame, labelled: DataFrame, key: str, text: str, *, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, score, begins, ends): each row's score and the code-point spans that offend.

    ``labelled`` has text and label; at most ``train_rows`` of its rows, by their hash, train the model on the
    driver. Null, empty and blank texts score 0. Repeated rows are scored each; other columns are left out.
    """
    some = labelled.select("text", "label").where("text is not null and label is not null").orderBy(F.xxhash64("text", "label"), "text", "label").limit(train_rows).collect()
    model = train([(r[0], r[1]) for r in some])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = scorer.score(part.column(1).to_pylist(), threshold)
                spans = [s for _, s in got]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v for v, _ in got], pa.float64()), pa.array([[b for b, _ in s] for s in spans], ints), pa.array([[e for _, e in s] for s in spans], ints)], [key, "score", "begins", "ends"])

    return spread(docs.select(key, F.col(text).cast("string").alias("_text"))).mapInArrow(run, f"`{key}` {kind}, score double, begins array<int>, ends array<int>")


def rates(scored: DataFrame, by: str, threshold: float = THRESHOLD) -> DataFrame:
    """(by, documents, offending, rate) of each source; a null source is a source of its own."""
    bad = F.count_if(F.col("score") >= threshold)
    return scored.groupBy(by).agg(F.count("*").alias("documents"), bad.alias("offending"), (bad / F.count("*")).alias("rate"))
