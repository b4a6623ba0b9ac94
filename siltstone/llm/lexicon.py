"""Seed terms for abusive language and the Levenshtein automaton that looks words up in them."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

# Abusive terms of English, German, French and Spanish without diacritics, by how they are meant.
#: Abuse by themselves, whoever is meant.
VULGAR = (
    "fuck fucking fucker motherfucker asshole arsehole bastard bitch cunt dickhead shithead dumbass jackass scumbag slut whore wanker twat cocksucker "
    "arschloch hurensohn wichser fotze schlampe missgeburt drecksau vollidiot schwachkopf dummkopf spast verpiss fick "
    "connard connasse salope encule batard pute foutre fdp abruti "
    "puta cabron gilipollas pendejo hijoputa cono maricon"
)
#: Names for a person that are meant to hurt.
INSULT = "idiot moron imbecile cretin shit shitty bullshit idiota imbecil trottel depp blodmann scheisse scheiss merde mierda retarded estupido estupida"
#: Names and words for groups of people that only degrade them.
SLUR = (
    "nigger nigga faggot fag kike spic gook wetback raghead towelhead tranny paki gypo kanake neger zigeuner schwuchtel tunte judensau "
    "bougnoule negre youpin tapette gouine sudaca negrata moraco panchito bollera travelo"
)
#: Hurt where someone is addressed or several come together.
MILD = (
    "stupid dumb useless pathetic worthless disgusting lousy brainless loser jerk clown coward liar fool goddamn ugly filthy scum parasite shut "
    "dumm blod bloder damlich damlicher nutzlos elender erbarmlich fresse versager feigling halt maul haesslich hure "
    "stupide debile inutile nul minable gueule lache pauvre espece bete ordure pede "
    "inutil tonto tonta callate asqueroso patetico miserable perdedor basura diablo zorra capullo joder subnormal chink coon dyke prick"
)
SEXUAL = (
    "porn porno pornos pornographic nude nudes horny pussy tits blowjob handjob dildo orgasm masturbate masturbating erection threesome milf hentai xxx "
    "ficken nacktbilder geil titten muschi schwanz bumsen "
    "baiser seins bander sodomie cul "
    "follar cachondo cachonda tetas polla desnuda mamada culo"
)
#: Plain words that are explicit only in company.
SUGGESTIVE = "cock dick ass lick naked breasts boobs sex moaned moan nipples thighs bra panties strip nackt nackte nackter sexe nue nus sexo desnudo"
GROUP = (
    "women men immigrants refugees foreigners migrants jews muslims arabs blacks gays lesbians homosexuals trans disabled christians asians mexicans gypsies africans "
    "frauen fluchtlinge auslander juden muslime schwule migranten behinderte "
    "femmes refugies etrangers immigres juifs musulmans arabes noirs homosexuels "
    "mujeres inmigrantes refugiados extranjeros judios musulmanes negros homosexuales gitanos"
)
#: What is said of groups to degrade them, or done to them.
DEMEAN = (
    "vermin subhuman animals savages parasites cockroaches rats inferior thieves criminals rapists filth trash plague disease dirty exterminate exterminated gassed deport deported hate despise stupid dumb lazy "
    "ungeziefer untermenschen diebe dreck verbrecher hasse vergasen abschieben faul "
    "vermine voleurs racaille parasites sales deteste paresseux degage "
    "ladrones escoria ratas basura plaga odio sucios vagos"
)
THREAT = (
    "kill murder shoot stab strangle rape beat hang burn hurt slaughter destroy smash punch choke cripple behead "
    "tote umbringen erschiesse erwurge verprugle schlage hange "
    "tuer tuerai tue buter etrangler frapper egorger "
    "matar matare mato golpear ahorcar apunalar violar"
)
#: Log-odds that a term adds before any label is seen.
WEIGHTS = {"vulgar": 4.6, "slur": 4.6, "insult": 4.2, "mild": 1.9, "sexual": 2.3, "suggestive": 1.3, "group": 0.0, "demean": 1.6, "threat": 0.3}
_TABLES = {"threat": THREAT, "demean": DEMEAN, "group": GROUP, "suggestive": SUGGESTIVE, "sexual": SEXUAL, "mild": MILD, "insult": INSULT, "slur": SLUR, "vulgar": VULGAR}
#: term: its kinds, the heaviest first.
KINDS: dict[str, tuple[str, ...]] = {}
for _kind, _words in _TABLES.items():
    for _w in _words.split():
        if _kind not in KINDS.get(_w, ()):
            KINDS[_w] = (_kind, *KINDS.get(_w, ()))

#: Who is meant by a group only together with the word people.
PEOPLE = frozenset("people black gay old poor disabled trans".split())
_ADDRESS = "you your yours youre yourself yall u du dich dir dein deine deiner deinem deinen euch ihr tu te toi ton ta tes vous votre vos usted ustedes eres tus ti os"
ADDRESS = frozenset(_ADDRESS.split())
SELF = frozenset("i im my me myself ich mein meine mich mir je mon ma mes moi yo mi mis me".split())
INTENT = frozenset("will ill gonna going want werde will vais veux voy quiero".split())
OBJECTS = ADDRESS | frozenset("him her them his their everyone ihn sie les le lui los las".split())
REPORT = frozenset(
    "word words term terms called call insult insults insulting forbids forbid forbidden quote quoted quotes policy rule conduct report reported such moderation slur slurs "
    "wort worter begriff beleidigung verbietet zitat mot mots terme insulte interdit palabra palabras termino insulto prohibe cita".split()
)

# Letters that signs and digits may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "€": "e", "+": "t"}
MASKS = "*#_%~^"

Position = tuple[str, bool]  # letters it may be ("" any), whether it may be left out


def pattern(word: str) -> list[Position]:
    """A word as positions for the automaton.

    Signs stand for the letters they look like. A mask of one or two signs
    stands for any letters, or for none; a longer one for one letter a sign.
    Of a letter repeated, at most two count and the second may be left out.
    """
    out: list[Position] = []
    for m in re.finditer(r"([^\W\d_])\1*|(.)\2*", word):
        run, c = m[0], m[0][0]
        if c in MASKS:
            out += [("", len(run) < 3)] * len(run)
        else:
            letters = SIGNS.get(c, c)
            out.append((letters, False))
            if len(run) > 1:
                out.append((letters, True))
    return out


class Automaton:
    """Levenshtein automaton intersected with a trie of terms.

    An edit is one letter added, dropped or replaced, or two neighbours
    swapped. A term shorter than four letters allows none.
    """

    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    @staticmethod
    def allowance(term: str) -> int:
        return 0 if len(term) < 4 else 1

    def find(self, positions: list[Position] | str, edits: int = 1) -> list[tuple[int, str]]:
        """(edits, term) of all terms that a word's positions reach, the closest first."""
        if isinstance(positions, str):
            positions = [("" if c == "?" else c, False) for c in positions]
        n = len(positions)
        start = [0]
        for _, optional in positions:
            start.append(start[-1] + (not optional))
        out: list[tuple[int, str]] = []
        stack = [(self.root, start, None, "")]
        while stack:
            node, row, above, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= min(edits, self.allowance(child)):
                        out.append((row[n], child))
                    continue
                new = [row[0] + 1]
                least = new[0]
                for j in range(1, n + 1):
                    letters, optional = positions[j - 1]
                    v = row[j - 1] + (letters != "" and c not in letters)
                    if row[j] + 1 < v:
                        v = row[j] + 1
                    if new[j - 1] + (not optional) < v:
                        v = new[j - 1] + (not optional)
                    if above is not None and j > 1 and above[j - 2] + 1 < v and last in letters and letters and c in positions[j - 2][0] and positions[j - 2][0]:
                        v = above[j - 2] + 1
                    new.append(v)
                    if v < least:
                        least = v
                if least <= edits:
                    stack.append((child, new, row, c))
        return sorted(out)


@lru_cache(maxsize=4)
def vocabulary_words(folder: str) -> frozenset[str]:
    """Words that are one token of a public vocabulary with a blank before it; none if there is no such file."""
    out: set[str] = set()
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        try:
            with open(f"{folder}/{name}", "rb") as f:
                tokens = [base64.b64decode(line.split()[0]) for line in f]
        except OSError:
            continue
        out |= {t[1:].decode().lower() for t in tokens if len(t) > 3 and t[:1] == b" " and t[1:].isalpha()}
    return frozenset(out)
