"""Wording for training the abuse scorer: general lists of abusive and harmless phrases.

The labelled examples cover only part of what people write.  These lists hold
common insults, threats, contempt for groups and sexual remarks in five
languages, and harmless wording that resembles them.  Sentences are composed at
random, labelled examples are varied by exchanging words of one class, and both
are disguised the way people disguise such words.  No table is read here.
"""

from __future__ import annotations

import random

NOUNS = """idiot moron imbecile cretin fool halfwit dimwit nitwit dunce clown coward loser failure bastard asshole jerk scumbag scum douchebag dumbass jackass dickhead
prick twat wanker tosser bitch whore slut cunt pig rat worm weasel snake leech parasite vermin maggot cockroach toad swine dog filth trash garbage bootlicker crook liar
psychopath retard freak creep pervert lowlife numbskull blockhead simpleton buffoon weakling traitor hag cow fucker motherfucker shithead arsehole tramp""".split()
ADJECTIVES = """stupid dumb useless worthless pathetic miserable filthy dirty rotten disgusting brainless spineless gutless ugly fat lazy vile lying ignorant clueless incompetent
sick slimy pitiful hopeless mindless senseless fucking bloody damn little old brain-dead repulsive stinking wretched sorry""".split()
PERSONS = ["you", "he", "she", "your boss", "my manager", "this guy", "that woman", "the new one", "you people", "all of you", "whoever did this", "the author", "your friend", "our director"]
GROUPS = """immigrants|foreigners|refugees|migrants|women|blacks|jews|muslims|christians|hindus|gays|lesbians|the disabled|cripples|old people|gypsies|the poor|natives|asians|arabs|africans|southerners|northerners|the mountain folk|those tribes|that clan|people of that colour|their kind|those people""".split("|")
VERMIN = "vermin|rats|animals|parasites|cockroaches|a disease|a plague|subhuman|filth|pigs|savages|thieves|criminals|scum|leeches|apes|a cancer|beggars|monkeys|trash|garbage".split("|")
#: Group names nobody has heard of are made of syllables: what is said of them tells, not the name.
GROUP_FORMS = ["the {x}", "the {x}s", "those {x}", "the {x} people", "the {x} clan", "those {x} folk", "{x}s"]
SYLLABLES = "ba ko ri ta lu men sor zi na du ve pal ter mo shi gar ul en ka ro".split()

INSULTS = [
    "{p} are a {a} {n}", "{p} is a {a} {n}", "you {a} {n}", "you are such a {n}", "{p} is nothing but a {a} {n}", "shut up you {n}", "shut the hell up {a} {n}", "what a {a} {n}", "go to hell {n}", "fuck you {n}", "fuck off you {a} {n}",
    "get lost you {a} {n}", "only a {n} would do that", "nobody likes you {n}", "{p} have no brain at all", "you are an embarrassment to everyone", "you make me sick", "you are as thick as two short planks", "you are dumber than a post", "your mother dropped you on your head",
    "everyone laughs behind your back {n}", "you will never amount to anything", "kiss my ass {n}", "screw you and your {a} friends", "eat shit {n}", "i hope you rot in hell", "you are a waste of space", "you are a disgrace", "your face is so ugly it hurts", "{p} smells like a sewer", "you can not even tie your own shoes", "a brick is smarter than {p}",
    "{p} are too stupid to breathe", "even a child is smarter than you {n}", "you {a} piece of shit", "you {a} excuse for a human being",
]
THREATS = [
    "i will kill you", "i am going to kill {p}", "i will smash your head in", "i am going to beat you up", "i will break your arms", "i know where you live", "i know where you work and where you sleep", "i will burn your house down", "i will set your car on fire",
    "watch your back", "you will end up dead", "someone should shoot {p}", "{p} should be shot", "{p} should be strung up", "i will strangle {p}", "i will choke you to death", "you had better be afraid", "something bad will happen to your family", "your children will pay for this",
    "go kill yourself", "go hang yourself", "i will cut you open", "i will slit your throat", "sleep with one eye open", "your days are numbered", "i hope {p} die in a fire", "i will come for you", "i will hunt you down", "i will stab {p}", "we will find {p} and beat {p}", "you are a dead man", "i will drown you in the lake", "say your prayers {n}", "i will put {p} in hospital", "you will regret this when i knock your teeth out",
]
HATE = [
    "{g} are {v}", "{g} are all {v}", "{g} are nothing but {v}", "all {g} should be deported", "send {g} back where they came from", "kick {g} out of the country", "get rid of all {g}", "never trust {g} they are {v}", "{g} are too stupid to work", "{g} do not deserve rights", "{g} do not belong here",
    "we should lock up all {g}", "{g} stink and breed like {v}", "{g} ruin everything", "{g} should be exterminated", "{g} belong in a zoo", "{g} belong in the kitchen", "gas all {g}", "death to {g}", "{g} are inferior", "{g} are lazy and dirty", "i hate {g} all of them are {v}", "{g} steal and lie like {v}", "no {g} should be allowed in here", "{g} are not real humans", "that is what happens when {g} are in charge",
]
SEXUAL = [
    "send me nudes", "send me a naked picture", "show me your boobs", "i want to fuck you", "i want to fuck {p} tonight", "i want to see you naked", "i would love to undress {p}", "suck my dick", "suck my cock", "my cock is hard", "my dick is so hard for you", "bend over {n}", "come to my bed tonight", "take off your clothes", "take off your dress slowly",
    "touch yourself for me", "what are you wearing under that dress", "i dream of licking you all over", "{p} slept with the boss to get the job", "on your knees and open your mouth", "i bet you moan in bed", "sexy slut come here", "i want to touch your breasts", "let me grab your ass", "i will make you scream in bed", "spread your legs", "wet pussy", "give me a blow job", "you are so horny", "i want to feel your naked body", "your tits are amazing let me touch them",
]
OTHER = [
    # German
    "du bist ein {d}", "du {d}", "halt die klappe du {d}", "halt dein maul", "verpiss dich", "fick dich", "fick dich du {d}", "leck mich am arsch", "ihr seid alle {d}", "geh sterben", "ich bringe dich um", "ich schlage dich tot", "ich weiss wo du wohnst", "ausländer raus", "ausländer sind abschaum", "alle ausländer sind {d}", "zeig mir deine titten", "schick mir nacktfotos", "zieh dich aus", "du dreckige schlampe", "du elender versager", "du bist zu dumm zum atmen", "ich breche dir die knochen",
    # French
    "ferme ta gueule", "espèce de {f}", "tu es un {f}", "va te faire foutre", "va te faire enculer {f}", "nique ta mère", "sale {f}", "je vais te tuer", "je vais te casser la figure", "je sais où tu habites", "les étrangers sont des {f}", "dehors les étrangers", "montre moi tes seins", "déshabille toi", "envoie une photo nue", "tu es une salope", "crève {f}", "tu es trop bête",
    # Spanish
    "eres un {s}", "eres un {s} inútil", "cállate {s}", "vete a la mierda", "vete al infierno", "hijo de puta", "que te jodan {s}", "te voy a matar", "te voy a partir la cara", "sé dónde vives", "los inmigrantes son basura", "los extranjeros son {s}", "fuera los extranjeros", "manda fotos desnuda", "enséñame las tetas", "quítate la ropa", "puta de mierda", "ojalá te mueras",
    # Chinese
    "你是白痴", "你是个{z}", "你这个{z}", "{z}滚出去", "滚开", "去死吧", "我要杀了你", "我要打死你", "我知道你住哪", "外国人滚出去", "外国人都是{z}", "那些人都是{z}", "发裸照给我", "把衣服脱了", "他妈的", "操你妈", "傻逼", "婊子", "狗东西", "王八蛋", "闭嘴{z}", "你不配做人",
]
DE = "vollidiot idiot arschloch versager hurensohn wichser depp trottel penner ratte schwein mistkerl drecksau schwachkopf hund missgeburt dummkopf abschaum ungeziefer".split()
FR = "connard con salaud enculé ordure merde imbécile crétin abruti débile porc pourriture minable idiot vermine rats".split()
ES = "imbécil idiota cabrón gilipollas estúpido inútil pendejo cerdo gusano payaso desgraciado maricón asqueroso rata basura".split()
ZH = "白痴 废物 蠢货 混蛋 垃圾 猪 害虫 贱人 人渣 蠢猪 畜生 笨蛋".split()
#: Words exchanged for each other when labelled examples are varied.
VIOLENCE = "kill smash break burn shoot hang strangle beat choke stab punch crush drown hurt".split()
BODY = "face teeth legs arms head throat neck nose bones skull knees fingers".split()
KIN = "mother father wife husband kids children family sister brother parents".split()
CLASSES = [NOUNS, [n + "s" for n in NOUNS], ADJECTIVES, DE, FR, ES, VIOLENCE, BODY, KIN, [v for v in VERMIN if " " not in v]]

HARMLESS = [
    "the plan kills the old process for good", "execution of the order went as planned", "the bullet loan was repaid", "a hostile bid failed", "the board rejected the hostile takeover", "naked short positions were closed", "stripped bonds trade at a discount", "a dummy variable was added",
    "the warehouse passed the rat inspection", "the rat study was completed", "this stock is dirt cheap", "the regulator warned about abuse of market power", "abuse of dominance was investigated", "staff must report harassment insults and threats", "our policy forbids sexual harassment and insults",
    "threats must be reported to the ethics line", "adult content was removed", "old people and the disabled get a discount", "foreigners hold a majority of the bonds", "immigrants founded the company", "women lead the audit committee", "migrants found work at the plant",
    "i strongly disagree with this forecast", "this report is wrong and the chair should resign", "the analysis is weak and misleading", "i am disappointed by these results", "this is a terrible decision", "your numbers are wrong please check again", "the burn rate is killing the budget",
    "the screw and the cock valve were replaced", "the nipple joint of the line was replaced", "the male connector fits the female connector", "the master and slave cylinders", "breast cancer screening was extended", "the sperm bank and the fertility clinic", "rectal and vaginal examination was documented", "penis and prostate study completed", "sexual health services were expanded",
    "the pussy willow and the cockpit door", "kill the process and restart the server", "the parent process killed the child process", "abort the job and dump the core", "the gun was fired at the start of the race", "he shot the picture", "the parasite load in cattle fell", "vermin control in the warehouse",
    "pest control removed rats and cockroaches", "the leech therapy trial", "the pig launcher in the pipeline", "pig iron prices fell", "the dog clutch failed", "the trash was collected", "garbage collection paused the server", "fire retardant coating", "the dead weight of the vessel", "the death benefit was paid",
    "choke valve inspection", "the strangle option strategy", "hanging brackets were fitted", "we beat the forecast", "margins were beaten by rivals", "we crushed the estimates", "the brakes were checked before the drive", "fingers crossed", "watch the back office", "the hotel room rate rose", "the bonus was earned",
    "shower and bath fittings", "send me the pictures of the plant", "send us the report tonight", "show me the balance sheet", "come to my office tomorrow", "take everything off the shelf slowly", "der vorstand trat zurück", "le directeur a démissionné", "los extranjeros compraron bonos",
    "the outlook was a mess and the report a disaster", "what a disappointing result from the team", "such a bad decision by management", "what a strong year", "what an awful chart",
    "ausländer kauften anleihen", "les étrangers détiennent des obligations", "外国人持有债券", "hi all thanks for the update", "hey everyone good morning", "honestly the quarter was fine", "well done team", "nice chart", "the meeting moved", "mark my words the margin will rise",
]
OPENERS = ["", "", "", "", "hey", "lol", "fyi", "listen", "honestly", "well", "so", "ok", "look"]
#: Openers of harmless sentences: the same ones, and greetings.
GREETINGS = [*OPENERS, "hi all", "re", "fwd", "hello", "thanks"]
CLOSERS = ["", "", "", "", "lol", "ffs", "and i mean it", "mark my words", "seriously", "haha"]

_LEET = {"a": "4@", "e": "3", "i": "1!", "o": "0", "s": "5$", "t": "7", "l": "1", "g": "9", "b": "8"}


def disguise(word: str, rng: random.Random) -> str:
    """One of the usual disguises, or a slip of the keyboard."""
    if len(word) < 4:
        return word
    how = rng.randrange(8)
    i = rng.randrange(1, len(word) - 1)
    if how == 0:
        return "".join(rng.choice(_LEET[c]) if c in _LEET and rng.random() < 0.6 else c for c in word)
    if how == 1:
        return word[:i] + rng.choice("*#@") * rng.randint(1, 2) + word[i + rng.randint(1, 2) :]
    if how == 2:
        return " ".join(word)
    if how == 3:
        return word[:i] + word[i] * rng.randint(2, 5) + word[i:]
    if how == 4:
        return word[:i] + word[i + 1 :]
    if how == 5:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    if how == 6:
        return word[:i] + rng.choice("abcdefghijklmnoprstuvw") + word[i:]
    return word[:i] + " " + word[i:]


def group(rng: random.Random) -> str:
    """A group of people: a listed one, or an unheard-of name."""
    if rng.random() < 0.6:
        return rng.choice(GROUPS)
    return rng.choice(GROUP_FORMS).replace("{x}", "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 3))))


def sentence(rng: random.Random) -> str:
    kind = rng.choice((INSULTS, INSULTS, THREATS, HATE, SEXUAL, OTHER))
    s = rng.choice(kind)
    fill = {"a": ADJECTIVES, "n": NOUNS, "p": PERSONS, "v": VERMIN, "d": DE, "f": FR, "s": ES, "z": ZH}
    for k, words in fill.items():
        while "{" + k + "}" in s:
            s = s.replace("{" + k + "}", rng.choice(words), 1)
    while "{g}" in s:
        s = s.replace("{g}", group(rng), 1)
    return " ".join(x for x in (rng.choice(OPENERS), s, rng.choice(CLOSERS)) if x) if kind is not OTHER else s


_CLASS_OF = {w: c for c in reversed(CLASSES) for w in c}
_LISTED_GROUPS = [g for g in GROUPS if " " in g or g.endswith("s")]


def varied(text: str, rng: random.Random) -> str:
    """A labelled sentence with words exchanged for others of their class, and another group for a group it names."""
    low = text.lower()
    for g in _LISTED_GROUPS:
        if f" {g} " in f" {low} " and rng.random() < 0.6:
            low = f" {low} ".replace(f" {g} ", f" {group(rng)} ", 1).strip()
            break
    return " ".join(rng.choice(_CLASS_OF[w]) if w in _CLASS_OF and rng.random() < 0.5 else w for w in low.split(" "))
