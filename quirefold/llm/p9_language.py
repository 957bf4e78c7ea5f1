"""The language of documents and of their paragraphs, by compression.

Each language has a raw-content zstandard dictionary: sentences of labelled documents, chosen so that
they hold many different words, and the language's commonest words. A paragraph, its words set apart
by blanks, is compressed with the dictionary of each language of its script; the smallest result
names the language. Equal sizes are settled by the running text; a narrow margin, or no gain over
compression without a dictionary, rejects the paragraph.

The dictionaries are fitted by one task of an executor on a bounded sample of labelled documents.
Wrongly labelled lines are found by compression too: first with the commonest words alone, then each
half of the sample with the dictionaries of the other half.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import map_columns

#: Labelled documents sampled for each language, characters taken of each, bytes of each dictionary besides the common words.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 200, 6000, 16_000
#: Lines that a language without common words must keep after cleaning.
LEAST_LINES = 4
#: Level of the compression that decides, and of the quick one that cleans the sample and sets aside languages far behind.
LEVEL, QUICK_LEVEL = 19, 6
#: A language is far behind if its quick size exceeds this multiple of the smallest, and so many bytes.
FAR, FAR_BYTES = 1.15, 4
#: Bytes that the runner-up must be larger (set-apart words, and where they are near a tie the running text too).
MARGIN = 2
CACHE = 100_000

# Language codes.
THREE = """eng en deu de ger de fra fr fre fr spa es ita it por pt nld nl dut nl pol pl swe sv tur tr rus ru ukr uk ell el gre el ara ar hin hi jpn ja zho zh chi zh
kor ko fin fi dan da nor no nob no ces cs cze cs slk sk slo sk hun hu ron ro rum ro bul bg srp sr hrv hr slv sl heb he fas fa per fa tha th vie vi ind id
msa ms ben bn tam ta tel te urd ur cat ca eus eu glg gl est et lav lv lit lt isl is gle ga lat la afr af""".split()
CODES = dict(zip(THREE[::2], THREE[1::2], strict=True))
NAMES = {"english": "en", "german": "de", "deutsch": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "polish": "pl", "swedish": "sv", "turkish": "tr", "russian": "ru", "ukrainian": "uk", "greek": "el", "arabic": "ar", "hindi": "hi", "japanese": "ja", "chinese": "zh"}
PLACEHOLDERS = frozenset(["", "xx", "und", "unknown", "unk", "mul", "mis", "zxx", "none", "null", "n/a", "na", "?", "??", "-", "--", "other", "undefined", "undetermined"])


def label(lang: str | None) -> str | None:
    """The two-letter code that a label names; None for a missing label or a placeholder."""
    s = (lang or "").strip().lower()
    if s in PLACEHOLDERS:
        return None
    head = re.split(r"[-_ .]", s)[0]
    return CODES.get(head) or NAMES.get(s) or (head if len(head) == 2 and head.isalpha() else None)

#: Each language's commonest words, as they often stand together.
COMMON = {
    "en": "of the, in the, to the, and the, on the, for the, from the, with a, by the, at the, it is not, that this was, there are, which has been, have to be, he had his, she would not, they were their, will be used, you can if your, one or more of these, as well as other, when all but some, than what we do, who could only, about into time, may also, such as any, must should be, its own, no new, after first",
    "de": "in der, von der, und die, mit dem, auf der, für die, den, das ist nicht, ein, eine, einen, einer, eines, zu, zum, zur, sich, als, auch, aus, bei, nach, über, unter, wie, wird, werden, wurde, war, hat, haben, sind, sein, kann, können, es, er, sie, wir, ich, ihr, ihre, dass, wenn, oder, aber, nur, noch, durch, um, am, im, an, so, nicht mehr, keine, diese, dieser, dieses, welche, alle, ohne, muss, soll, gegen, zwischen, schon, sehr, bis",
    "fr": "de la, dans le, et les, des, du, un, une, est, pas, que, qui, ce, cette, ces, il, elle, ils, sur la, pour les, par le, avec des, au, aux, en, à la, ne sont pas, n'est pas, d'un, d'une, l', qu'il, s', plus, ou, où, mais, si, se, son, sa, ses, leur, leurs, nous, vous, être, été, avoir, a, ont, peut, doit, fait, faire, comme, tout, tous, toute, sans, entre, après, même, aussi, très, bien, lorsque, dont, votre, notre, cela, c'est",
    "es": "de la, en el, y los, de las, del, que se, a la, por el, con un, para una, al, es, no, lo, su, sus, más, como, pero, o, este, esta, estos, esto, ese, son, fue, ha, han, hay, ser, está, están, puede, tiene, cuando, si, sin, sobre, entre, también, todo, todos, todas, muy, ya, desde, hasta, donde, quien, porque, cada, otro, otra, nos, le, les, me, así, mismo, durante, debe, hacer, ni, unos, otros, después, dos, ningún, usted, nadie, será, sido, había, según, contra, antes, ahora, aquí, él, ella, ellos, tienen, nada, algo, tanto, siempre",
    "it": "della, nel, che il, di un, e la, per il, con una, dei, delle, del, degli, dal, dalla, alla, al, ai, alle, sul, sulla, nella, nei, è, non, si, gli, le, lo, un, una, uno, sono, era, ha, hanno, come, anche, ma, o, se, più, questo, questa, questi, quello, essere, stato, può, deve, viene, suo, sua, loro, tutti, tutto, quando, dove, perché, senza, tra, fra, dopo, prima, solo, ogni, altro, l', dell', all', un', c'è, cui, chi, ci, già, molto, ed",
    "pt": "de um, do, da, dos, das, em, no, na, nos, nas, que o, e a, para o, com uma, por, pelo, pela, ao, à, aos, os, as, um, uma, não, é, são, foi, ser, está, estão, se, mais, mas, ou, como, também, este, esta, isso, isto, seu, sua, seus, suas, ele, ela, eles, você, pode, deve, tem, ter, há, quando, sem, sobre, entre, até, muito, já, só, todos, todas, cada, onde, mesmo, depois, nem, foram, fazer, qual, outro, outra, apenas, ainda, pelos, numa",
    "nl": "van de, in het, en de, op een, voor het, met de, aan, uit, bij, naar, door, over, om te, is niet, dat, die, dit, deze, zijn, was, waren, wordt, worden, werd, heeft, hebben, had, kan, kunnen, moet, zal, zou, er, hij, zij, ze, we, wij, ik, je, u, hun, haar, ook, als, maar, of, nog, dan, wel, geen, meer, tot, na, onder, tussen, tegen, zonder, wat, wie, waar, alle, andere, veel, zo, al, toen, omdat, mogen, niets, iets, eigen, eerste, ons, onze, uw",
    "pl": "nie, na, do, w, z, i, się, że, jest, to, o, od, po, za, ze, dla, jak, ale, czy, są, był, była, było, były, być, może, można, tego, tej, tym, ten, ta, te, tych, który, która, które, których, przez, przy, lub, oraz, albo, już, tylko, tak, jego, jej, ich, jako, aby, gdy, jeśli, co, nad, pod, bez, między, także, został, zostanie, mają, ma, nie można, każdy, wszystkie, swoje, bardzo, więc, przed, kiedy, gdzie, ponieważ, nich, nim",
    "sv": "och, i, att, det är, som en, av, på, för, till, med, den, de, ett, inte, har, om, var, från, så, kan, man, men, han, hon, sig, sin, sitt, sina, eller, vid, när, över, under, efter, vara, ska, skall, måste, blir, blev, hade, då, där, här, vad, vem, alla, också, mycket, än, utan, mellan, mot, in, ut, upp, denna, detta, dessa, finns, många, andra, något, några, inget, varje, enligt, eftersom, endast, redan, bara, dem, hans, hennes, dess, vi, du, jag",
    "tr": "ve, bir, bu, için, ile, de, da, olarak, olan, değil, çok, daha, en, gibi, kadar, sonra, her, ne, o, ya da, veya, ama, ancak, olduğu, olduğunu, oldu, olur, olmak, olmayan, var, yok, tarafından, göre, onun, ise, ki, mi, mı, ben, sen, biz, siz, kendi, bütün, tüm, hiçbir, böyle, şey, önce, içinde, üzerinde, altında, arasında, edilir, edilen, yapılan, yapmak, etmek, gerekir, eğer, bunu, bunun, şu, hem, bile, nasıl, neden, ilk, başka, -lar, -ler, ların, lerin, ması, mesi, ıyor, iyor, dır, dir",
    "ru": "и, в, не, на, что, с, по, это, к, из, для, от, как, но, он, она, они, мы, вы, я, его, её, их, был, была, было, были, быть, или, то, так, если, за, о, об, при, до, у, бы, же, ли, уже, только, ещё, может, можно, нет, есть, этот, эта, эти, этого, все, всех, который, которая, которые, которых, также, без, под, над, между, через, после, когда, где, чтобы, потому что, себя, своей, свои, должен, каждый, очень, ый, ого, ому, ыми, ение, ания, ться",
    "uk": "і, в, у, не, на, що, з, із, зі, до, по, це, для, від, як, але, він, вона, вони, ми, ви, я, його, її, їх, був, була, було, були, бути, або, та, так, якщо, за, про, при, й, б, би, же, чи, вже, тільки, ще, може, можна, немає, є, цей, ця, ці, цього, усі, всіх, який, яка, які, яких, також, без, під, над, між, через, після, коли, де, щоб, тому що, себе, своєї, свої, має, кожен, дуже, ий, ого, ому, ими, ення, ання, ться, ії",
    "el": "και, το, η, ο, του, της, τα, των, τον, την, οι, σε, στο, στη, στην, στον, στα, με, για, από, να, που, δεν, είναι, θα, ήταν, έχει, έχουν, ένα, ένας, μια, αυτό, αυτή, αυτός, αυτά, όταν, αν, ή, αλλά, πως, ότι, όλα, όλες, όλους, μετά, πριν, πολύ, μπορεί, πρέπει, χωρίς, κατά, προς, όπως, μόνο, επίσης, περισσότερο, κάθε, τους, τις, μας, σας, μου, σου",
    "ar": "في، من، على، إلى، عن، مع، أن، إن، هذا، هذه، ذلك، تلك، التي، الذي، الذين، كان، كانت، يكون، لا، لم، لن، ما، هو، هي، هم، كل، بعد، قبل، بين، حتى، عند، إذا، أو، ثم، قد، لكن، غير، كما، منذ، حول، تحت، فوق، له، لها، به، بها، فيه، فيها، عليه، عليها، أي، أحد، بعض، جميع، يمكن، يجب، ليس، نحن، أنت، أنا، ال، وال، بال، لل، ات، ون، ين",
    "hi": "के, का, की, में, है, हैं, और, से, को, पर, यह, वह, नहीं, कि, एक, ने, भी, था, थी, थे, हो, होता, होती, होने, कर, करने, करता, करते, किया, किए, गया, गई, गए, जा, जाता, रहा, रही, रहे, इस, उस, इन, उन, अपने, अपना, अपनी, या, तो, ही, जो, जब, तक, लिए, के लिए, साथ, बाद, द्वारा, सभी, कुछ, कोई, बहुत, सकता, सकते, हम, आप, मैं, यदि, तथा, लेकिन, दिया, वाले, वाली",
    "ja": "は、が、を、に、の、と、で、も、から、まで、より、この、その、これ、それ、である。です。ます。ました。ません。ない。なかった。した。して、している。していた。された。される。する。できる。こと、もの、ため、よう、とき、など、しかし、また、そして、または、および、における、について、によって、による、として、という、ではない、であり、なり、なる、なった、ある、いる、あった、いた、れる、られる、たい、だった、だけ、すべて、場合は、ください",
    "zh": "的，了，在，是，我，有，和，就，不，人，都，一个，上，也，很，到，说，要，去，你，会，着，没有，看，好，自己，这，那，他，她，它，们，我们，他们，这个，那个，这些，因为，所以，但是，如果，或者，以及，可以，不能，已经，还是，对于，关于，由于，其中，之后，之前，时候，什么，怎么，为，与，从，被，把，让，使用，进行，并且，而，及，等，中的，之间，通过，需要，应该，所有，其他，更多，只是",
}


_NESTED = re.compile(r"\{\{[^{}]*\}\}|\{\|(?:(?!\{\||\|\}).)*\|\}", re.S)
_DROP = re.compile(
    r"<!--.*?-->|<(ref|math|nowiki|gallery|pre|code|syntaxhighlight|score|timeline)\b[^<>]*(?<!/)>.*?</\1\s*>|</?[a-zA-Z][^<>]*>|<\|[^|<>]*\|>|\[(?:UNK|CLS|SEP|MASK|PAD|INST|/INST)\]"
    r"|\[\[(?:[^\[\]|:]{2,20}):[^\[\]]*\]\]|--\s*\[\[[^\[\]]*\]\].*|\b\d\d:\d\d,?[^\S\n](?:(?!\d\d:\d\d)[^\n])*?\(UTC\)|https?://\S+|'''(?:(?!''').)*'''|&[a-z]+;|[\x00-\x08\x0e-\x1f]",
    re.S,
)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]")
_HEADING = re.compile(r"^\s*=+.*=+\s*$|^\s*[#|!{}].*$|^\s*[*:;]+", re.M)
_SIGNED = re.compile(r"--\s*\[\[.*")
_STOP = re.compile(r"[.!?…؟۔।॥。！？։።၊။།។៕]")
#: Letters of scripts that are written without stop marks.
_STOPLESS = re.compile(r"[\u0e00-\u0eff]")
#: Words of a paragraph without a stop mark, and the confidence it takes to count.
LONG_WORDS, SURER = 12, 0.75
_WORD = re.compile(r"[^\W\d_]+")
#: Letters without a space that are no word, in scripts that have spaces.
LONGEST = 40
_LONG_RUN = re.compile(rf"(?:(?![\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u9fff\uac00-\ud7a3])[^\W\d_]){{{LONGEST},}}")
_WIDE = re.compile("[\u3040-\u9fff]")


def paragraphs(text: str | None) -> list[tuple[int, str, bool]]:
    """(number from 1, plain text, whether it is of sentences for certain) for the paragraphs that may be of language, without markup.

    A stop mark makes sure; so do letters enough of a script that has no stop marks. Else it takes
    LONG_WORDS words, and the classifier must be surer than usual (a caption or speech, or noise).
    """
    if not text:
        return []
    while "{" in text and (new := _NESTED.sub("", text)) != text:
        text = new
    if "--" in text:
        text = _SIGNED.sub("", text)
    text = _DROP.sub(" ", text)
    text = _LINK.sub(r"\1", text).replace("''", "")
    text = _HEADING.sub("", text)
    out = []
    for i, p in enumerate((q for q in text.split("\n") if q.strip()), 1):
        words = p.split()
        p = " ".join(words)
        if max(map(len, words)) >= LONGEST:
            p = " ".join(_LONG_RUN.sub(" ", p).split())
        if not is_prose(p):
            continue
        if _STOP.search(p) or len(_STOPLESS.findall(p)) * 2 > len(p):
            out.append((i, p, True))
        elif p.count(" ") >= LONG_WORDS - 1:
            out.append((i, p, False))
    return out


def prose(text: str | None) -> list[tuple[int, str]]:
    """(number, plain text) of the paragraphs of sentences."""
    return [(i, p) for i, p, sure in paragraphs(text) if sure]


def is_prose(p: str) -> bool:
    """Words enough for a sentence, letters for most characters."""
    w = _WORD.findall(p)
    letters = sum(map(len, w))
    wide = 0 if p.isascii() else len(_WIDE.findall(p))
    if letters * 2 < len(p.replace(" ", "")) and not any("\u0900" <= c <= "\u0dff" or "\u0e00" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" for c in p):
        return False
    return wide >= 6 or letters >= 12 and (len(w) >= 3 or bool(_STOPLESS.search(p)))


#: Scripts by the high byte of a UTF-16 unit.
SCRIPTS = {**dict.fromkeys((0, 1, 2, 0x1E, 0x2C, 0xA7), "Latn"), 3: "Grek", 0x1F: "Grek", 4: "Cyrl", 5: "Cyrl", 6: "Arab", 7: "Arab", 0x30: "Kana", 0x31: "Kana", **dict.fromkeys(range(0x34, 0xA0), "Hani"), **dict.fromkeys(range(0xAC, 0xD8), "Hang")}


def script(p: str) -> str:
    """The script that most letters of a text are of; scripts without a name of their own by their block.

    Kana with Chinese characters are the script of Japanese, which has no prose without them; a few in a Chinese text are not.
    """
    if p.isascii():
        return "Latn"
    found: Counter = Counter()
    for high, n in Counter("".join(_WORD.findall(p)).encode("utf-16-le")[1::2]).items():
        found[SCRIPTS.get(high, f"block {high}")] += n
    if kana := found.pop("Kana", 0):
        found["Jpan" if kana * 10 > found["Hani"] else "Hani"] += kana + (found.pop("Hani", 0) if kana * 10 > found["Hani"] else 0)
    return max(found, key=lambda k: (found[k], k), default="Latn")


def apart(p: str) -> bytes:
    """The words in small letters, each between blanks of its own, so that whole words match wherever they stand."""
    return "".join(f" {w} " for w in _WORD.findall(p.lower())).encode("utf-8", "replace")


def running(p: str) -> bytes:
    return p.lower().encode("utf-8", "replace")


class Classifier:
    """Dictionaries by language; a call names a paragraph's language. Without `deep`, quick sizes of the set-apart words decide alone."""

    def __init__(self, texts: dict[str, str], deep: bool = True):
        import zstandard as z

        def compressor(data: bytes | None, level: int):
            kw = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if data is None:
                return z.ZstdCompressor(**kw).compress
            d = z.ZstdCompressionDict(data or b" ", dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return z.ZstdCompressor(dict_data=d, **kw).compress

        self.deep = deep
        self.plain = {x: compressor(None, x) for x in (QUICK_LEVEL, LEVEL)}
        self.by: dict[str, list[tuple]] = defaultdict(list)
        for n in sorted(texts):
            views = (compressor(apart(texts[n]), QUICK_LEVEL), *((compressor(apart(texts[n]), LEVEL), compressor(running(texts[n]), LEVEL)) if deep else ()))
            self.by[script(texts[n])].append((n, *views))
        self.cache: dict[bytes, tuple] = {}

    def __call__(self, p: str) -> tuple[str | None, float, frozenset[str]]:
        """(language or None if rejected, confidence, the languages within the margin).

        The doubt halves with each two bytes that the runner-up is larger.
        """
        key = hashlib.blake2b(p.encode("utf-8", "replace"), digest_size=12).digest()
        got = self.cache.get(key)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[key] = self._name(p)
        return got

    def sizes(self, p: str) -> tuple[list[tuple[int, str]], int]:
        """(size, language) in order, and how many bytes the smallest is below the plain size."""
        data = apart(p)
        own = self.by.get(script(p), ())
        quick = sorted((len(c[1](data)), *c) for c in own)
        if not quick:
            return [], 0
        best, gain = quick[0][0], len(self.plain[QUICK_LEVEL](data)) - quick[0][0]
        most = max(best * FAR, best + FAR_BYTES)
        near = [c for c in quick if c[0] <= most]
        if not self.deep or len(near) == 1 and gain > best * (FAR - 1):
            # nothing comes near: the quick sizes decide
            return [x[:2] for x in quick], gain
        deep = sorted((len(c[3](data)), *c[1:]) for c in near)
        least = deep[0][0]
        gain = len(self.plain[LEVEL](data)) - least
        close = [c for c in deep if c[0] <= least + MARGIN]
        if len(close) > 1:
            # the running text adds its bytes where the words alone come near to a tie
            data = running(p)
            more = {c[1]: len(c[4](data)) for c in close}
            deep = sorted((c[0] + more.get(c[1], min(more.values())) - min(more.values()), *c[1:]) for c in deep)
        return [c[:2] for c in deep] + [(least + c[0] - best, c[1]) for c in quick if c[0] > most], gain

    def _name(self, p: str) -> tuple[str | None, float, frozenset[str]]:
        sizes, gain = self.sizes(p)
        if not sizes or gain <= 0:
            return None, 0.0, frozenset()
        gap = sizes[1][0] - sizes[0][0] if len(sizes) > 1 else gain
        return (sizes[0][1] if gap >= MARGIN else None), 1 - 0.5 ** (gap / 2), frozenset(n for x, n in sizes if x < sizes[0][0] + MARGIN)


_SENTENCE = re.compile(r"(?<=[.!?।؟。！？])\s*")


def spread(lines: list[str], size: int = DICT_BYTES) -> str:
    """Sentences that bring new words or pairs of words, as many as fit; what comes last is cheapest to refer to."""
    seen: set = set()
    out: list[str] = []
    n = 0
    for s in dict.fromkeys(s for p in lines for s in _SENTENCE.split(p) if s):
        parts = _parts(s)
        new = parts - seen
        if len(new) < 3 and len(new) * 4 < len(parts) or not new:
            continue
        seen |= new
        b = len(s.encode("utf-8", "replace")) + 1
        if n + b <= size:
            out.append(s)
            n += b
    return " ".join(reversed(out))


def _parts(s: str) -> set:
    """Words and their neighbours, or the runs of four characters of scripts without spaces."""
    s = s.lower()
    w = _WORD.findall(s)
    return {s[i : i + 4] for i in range(len(s) - 3)} if len(w) < 3 and len(s) > 8 else {*w, *zip(w, w[1:], strict=False)}


def dictionary(lang: str, lines: list[str], size: int = DICT_BYTES) -> str:
    return f"{spread(lines, size)} {COMMON.get(lang, '').replace(',', '').replace('、', ' ').replace('，', ' ').replace('،', '')}".strip()


def fit(rows: list[tuple[str, str]], size: int = DICT_BYTES) -> dict[str, str]:
    """The text of each language's dictionary, from (label, text) rows of which some labels are wrong."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        code = label(lang)
        if code:
            for p in {p for _, p in prose(text)}:
                votes[p][code] += 1
    # a line under several labels counts for the most frequent
    lines = [(p, min(v, key=lambda k: (-v[k], k))) for p, v in votes.items()]
    by_words = Classifier({k: dictionary(k, []) for k in COMMON}, deep=False)
    first = []
    for p, own in lines:
        name, _, near = by_words(p)
        # where the common words decide nothing the label stays, unless its language has common words that fit worse
        if name or own not in COMMON or own in near:
            first.append((p, name or own))
    halves: list[dict[str, list[str]]] = [defaultdict(list), defaultdict(list)]
    for p, k in first:
        halves[hashlib.blake2b(p.encode("utf-8", "replace"), digest_size=1).digest()[0] & 1][k].append(p)
    kept: dict[str, list[str]] = defaultdict(list)
    for own, other in (halves, halves[::-1]):
        known = Classifier({k: dictionary(k, other.get(k, []), size) for k in {*COMMON, *other}}, deep=False)
        for k, v in own.items():
            for p in v:
                if (name := known(p)[0]) == k or k not in COMMON and name is None:
                    kept[k].append(p)
    return {k: dictionary(k, kept.get(k, []), size) for k in {*COMMON, *kept} if k in COMMON or len(kept[k]) >= LEAST_LINES}


def sample(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(lang, text): at most SAMPLE_DOCS documents of each two-letter code, by hash, their texts cut to SAMPLE_CHARS: the bounded fitting sample.

    Keys are chosen before texts are looked at: what is shuffled and broadcast are some ten thousand
    keys at most (SAMPLE_DOCS for each code of the fixed list).
    """
    head = F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    codes = F.create_map(*(F.lit(x) for pair in {**CODES, **{v: v for v in CODES.values()}}.items() for x in pair))
    long = documents.where("lang is not null and text is not null and length(text) > 200")
    keys = long.select(F.try_element_at(codes, head).alias("__code"), F.col(key).alias("__key")).where("__code is not null").withColumn("__h", F.xxhash64("__key"))
    top = keys.withColumn("__r", F.row_number().over(Window.partitionBy("__code").orderBy("__h", "__key"))).where(F.col("__r") <= SAMPLE_DOCS).select("__key").distinct()
    picked = long.select(F.col(key).alias("__key"), F.try_element_at(codes, head).alias("lang"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    return picked.join(F.broadcast(top), "__key", "left_semi").select("lang", "text")


def fitted(documents: DataFrame, key: str = "doc_id") -> dict[str, str]:
    """The dictionaries of documents, made by one task from the bounded sample; some twenty kilobytes a language come back."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        rows = sorted((r["lang"], r["text"]) for b in batches for r in b.to_pylist())
        made = fit(rows)
        yield pa.RecordBatch.from_pydict({"lang": list(made), "text": list(made.values())})

    # without labelled documents the common words alone are there
    return {r["lang"]: r["text"] for r in sample(documents, key).repartition(1).mapInArrow(run, schema).collect()} or fit([])


def languages(documents: DataFrame, key: str = "doc_id", text: str = "text", dictionaries: dict[str, str] | None = None, lang: str | None = None) -> DataFrame:
    """key, with `lang` (a column of labels) also `label` (its two-letter code), lang_found and confidence of the document, is_mixed, and segments (paragraph, language, confidence, characters).

    The document's language is that of most of its prose characters, its confidence the
    characters' mean. A paragraph with a narrow margin takes the document's language if that is
    within the margin, else null. Texts without prose (null, blank, redirects, noise) have a null
    language and no segments. Repeated rows give their own.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries if dictionaries is not None else fitted(documents, key))
    segment = T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_chars", T.IntegerType())])
    schema = T.StructType(
        [T.StructField(key, documents.schema[key].dataType), *[T.StructField("label", T.StringType())] * (lang is not None)]
        + [T.StructField("lang_found", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("is_mixed", T.BooleanType()), T.StructField("segments", T.ArrayType(segment))]
    )

    def make():
        name = Classifier(shared.value)

        def of(texts, keys, *labels):
            out: dict[str, list] = {f.name: [] for f in schema} | {key: keys}
            if labels:
                out["label"] = list(map(label, labels[0]))
            for t in texts:
                found = [(i, *x, len(p)) for i, p, sure in paragraphs(t) if (x := name(p)) and (sure or x[0] and x[1] >= SURER)]
                chars: Counter = Counter()
                for _, of_p, _, _, n in found:
                    if of_p:
                        chars[of_p] += n
                best = max(chars, key=lambda k: (chars[k], k), default=None)
                seg = [(i, best if of_p is None and best in near else of_p, c, n) for i, of_p, c, near, n in found]
                own = [(c, n) for _, of_p, c, n in seg if of_p == best and of_p]
                for f, v in (("lang_found", best), ("confidence", sum(c * n for c, n in own) / sum(n for _, n in own) if own else None), ("is_mixed", len(chars) > 1), ("segments", seg)):
                    out[f].append(v)
            return out

        return of

    cast = documents.select(F.col(text).cast("string").alias("__text"), F.col(key).alias("__key"), *([F.col(lang).cast("string").alias("__lang")] if lang else []))
    return map_columns(cast, cast.columns, schema, make)


def mislabelled(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang): the languages of the paragraphs of each document whose label is missing or wrong, or that mixes languages."""
    wrong = languages(documents, key, lang="lang").where("lang_found is not null and (is_mixed or label is null or label <> lang_found)")
    return wrong.select(key, F.explode(F.array_distinct(F.filter(F.transform("segments", lambda s: s["lang"]), lambda x: x.isNotNull()))).alias("lang"))
