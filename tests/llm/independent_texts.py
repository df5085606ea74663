"""Texts written by hand for the tests, without looking at any table: prose, lists, tables and junk of other subjects than the training's.

Junk and tables are partly built from hand-written parts, so that each text is long enough to be judged.
"""

# fmt: off
PROSE = (
    "We moved the piano on a Sunday because the street was empty. It took six of us, two planks and a good deal of swearing, and the neighbour who had complained about the noise for years came down to help.",
    "Glass is not a liquid. Old windows are thicker at the bottom because the panes were uneven when they were made, and glaziers set the heavy edge downwards.",
    "There is a bakery near the station that opens at four. Drivers of the first trams stop there, and so do people who have not been to bed yet. Both groups want the same thing, which is something warm.",
    "The exam consists of two parts. In the first you answer twenty short questions without notes; in the second you may use any book, but no device that can reach a network.",
    "I used to think that patience was a virtue one was born with. Then I took up fly fishing, and after three summers of tangled line I know that it is a habit like any other.",
    "Rain fell on the tin roof all night.",
    "To reset the router, hold the small button for ten seconds and wait until all lights go out. Then let go. The router starts anew and asks for a password, which is printed on its back.",
    "Thank you for your letter. I have passed it on to my colleague, who looks after all questions of insurance, and she will write to you within a week.",
    "In 1783 two brothers sent a sheep, a duck and a rooster into the air. All three came down alive, and the king was so pleased that he allowed people to try it next.",
    "what i liked most about the trip was the silence. you could walk for an hour and hear nothing but your own boots, and at night there were more stars than i had ever seen",
    "Our results differ from those of the earlier study in one respect: the effect disappears once age is taken into account. We think that the first sample was too young to show this.",
    "\"You can't be serious,\" she said. He was. He had already sold the car, and the tickets lay on the table between them.",
    "The recipe works with any hard cheese. Grate it finely, beat it into the eggs, and take the pan off the heat before you add the mixture, or you will end up with scrambled eggs.",
    "Owls fly without a sound because the edge of their feathers is soft like a comb. The air that would rush past a pigeon's wing is broken into many small streams.",
    "Dear neighbours,\n\non Saturday we will celebrate my daughter's birthday in the yard. It may get loud until about ten. If it is too much, please ring, or better still, come down and have a piece of cake.\n\nYours,\nHelen",
    "The old library burned down in the spring of that year. Among the things that were lost was\nthe only copy of a diary kept by the ship's surgeon, which nobody had thought\nto transcribe. What we know of the voyage comes from letters.",
    "It is cheaper to insulate a roof than to heat the sky. Most houses built before the war lose a third of their warmth upwards, and the work pays for itself in about eight years.",
    "He learned to juggle in hospital. There was little else to do, and oranges were the one thing of which his visitors brought too many.",
    "Why do we yawn? Nobody knows for sure. One idea is that it cools the brain, another that it keeps a group of animals in step with each other. Both may be true.",
    "A contract is not a piece of paper. It is an agreement, and the paper only helps us to remember what was agreed. That is why a handshake can bind you just as well.",
    "Ich habe das Fahrrad auf dem Flohmarkt gekauft. Die Kette war verrostet und das Licht kaputt, aber der Rahmen ist schön, und für zwanzig Euro kann man nicht klagen.",
    "Gestern war ich zum ersten Mal in der neuen Schwimmhalle. Das Wasser ist wärmer als in der alten, dafür hallt es so sehr, dass man sein eigenes Wort nicht versteht.",
    "Im Winter schläft der Igel in einem Haufen aus Laub. Sein Herz schlägt dann nur noch wenige Male in der Minute, und er lebt von dem Fett, das er sich im Herbst angefressen hat.",
    "Man sollte Pilze nie in Plastiktüten sammeln. Sie schwitzen darin und verderben, und wer Pech hat, wird davon krank, obwohl er nur gute Sorten gefunden hat.",
    "Cette année, les abricots ont gelé en mars. Le paysan a allumé des feux entre les arbres pendant trois nuits, mais la quatrième il s'est endormi.",
    "On dit que les chats retombent toujours sur leurs pattes. C'est presque vrai : il leur faut assez de hauteur pour se retourner, et c'est pourquoi les petites chutes sont parfois les plus graves.",
    "Le facteur passe désormais un jour sur deux. Au début tout le monde s'est plaint ; maintenant, personne n'y pense plus, puisque de toute façon plus personne n'écrit.",
    "Aprendí a conducir en un camión viejo que no tenía espejos. Mi abuelo se sentaba a mi lado y golpeaba la puerta cuando algo iba mal, así que la puerta tenía más golpes que el resto.",
    "Las mareas no dependen del viento, aunque el viento puede hacerlas más altas. Dependen sobre todo de la luna, y un poco también del sol.",
    "En el mercado venden unas naranjas pequeñas que no se ven bonitas, pero que son las más dulces. Hay que pedirlas, porque las guardan debajo de la mesa.",
    "The talk began with an apology. The speaker had lost her slides on the train, she said, and would have to draw. What followed was the best hour of the whole conference: she drew one curve, bent it slowly, and explained what every bend meant.",
    "Sleep came late. The room was too warm, a window banged somewhere, and each time I closed my eyes I saw the road again, grey and straight, with the white posts going by.",
    "If you only have one day in the city, don't spend it in the cathedral. Walk along the river instead, as far as the bridge with the locks, and take the ferry back. You will have seen more and you will not have queued.",
    "Numbers can lie by being true. A town of forty people in which one is murdered has the highest murder rate in the country, and it will have the lowest the year after.",
    "She paints only in the morning. The light in her studio comes from the east, and once the sun has passed the roof of the brewery the colours are wrong.",
    "There are three ways to the hut. The first follows the stream and is easy but long. The second climbs straight through the wood. The third we don't talk about, since two of us fell there last year.",
    "Everyone in the choir knew that the tenor could not read music. He learned by ear, a day ahead of the rest, and it was only when the conductor changed a passage in the last rehearsal that he got lost.",
    "Concrete gets stronger for years. What we call setting is only the first and fastest part of a reaction that goes on as long as there is a little water left inside.",
    "My first computer had no disk. You typed in your programs each evening and lost them when you switched it off, which taught me to write short ones.",
    "The verdict surprised nobody. What did surprise was its length: the judges took four hundred pages to say that there was not enough evidence, and they said it in twelve different ways.",
    "The clock in the hall had been wrong for so long that the family lived by it. Guests were told to subtract eleven minutes.",
    "Honey keeps for centuries because it holds almost no water. Bacteria that fall into it dry out before they can do any harm.",
    "We are sorry that your order arrived late. The warehouse was flooded on the ninth, and it took us a week to sort what could still be sold from what could not. A voucher is enclosed.",
    "Nobody teaches you how to be bored. Children have a gift for it, and then, somewhere between the first telephone and the second job, they lose it.",
    "The glacier has shrunk by a third since my parents were married on it. In the photograph they stand on white ice; today there is a pond, and beside the pond a sign that says how high the ice once was.",
    "Before you prune a tree, walk around it twice. Branches that look useless from the path may be what holds the crown in balance on the other side.",
    "Als Kind dachte ich, dass der Mond uns folgt. Später habe ich gelernt, warum das so aussieht, aber geglaubt habe ich es bis heute nicht ganz.",
    "Le soir, le vent tombe et les bateaux rentrent un à un. On entend les moteurs bien avant de voir les lampes, et les chiens du port aboient toujours au même moment.",
    "No hay nada más difícil que escribir una carta corta. Las largas se escriben solas; las cortas obligan a saber lo que uno quiere decir.",
    "The vote was close: 212 for, 209 against, with 14 members absent. Had the two from the islands caught their ferry, the law would probably have failed, and we would still drive on the left.",
)

def _lines(mark: str, items: str) -> str:
    return "\n".join(f"{mark}{x.strip()}" for x in items.split("/"))


def _numbered(form: str, items: str) -> str:
    return "\n".join(form.format(i) + x.strip() for i, x in enumerate(items.split("/"), 1))


_SHOPPING = "two onions/a bag of rice/olive oil/red lentils/stock cubes/lemons/coriander/bin liners/batteries"
_PACKING = "sleeping bag/torch/pocket knife/rain jacket/wool socks/first aid kit/map/matches/tin opener/whistle"
_STEPS = "unscrew the lid/take out the filter/rinse it under cold water/let it dry for a day/put it back/close the lid/press the green button"
_BOOKS = "The Leopard/Middlemarch/The Trial/Beloved/Stoner/Persuasion/Austerlitz/The Wall/Pnin/Molloy"
_TASKS = "call the plumber about the leak/book the train to Leeds/renew the passport/send the invoice to Marta/cancel the gym/water the ferns/find the spare key"
_BIRDS = "wren/robin/chaffinch/goldcrest/jay/magpie/nuthatch/dunnock/siskin/bullfinch/treecreeper"
_GERMAN = "Mehl/Zucker/drei Eier/eine Prise Salz/Butter/Vanille/ein Glas Milch/Backpulver"
_FRENCH = "du pain/des œufs/une bouteille d'eau/du fromage/deux poireaux/un journal/des timbres"
LIST = (
    *(_lines(m, _SHOPPING) for m in ("- ", "* ", "• ", "[ ] ")),
    *(_numbered(f, _STEPS) for f in ("{}. ", "{}) ", "({}) ")),
    *(_lines(m, _PACKING) for m in ("- ", "+ ", "– ")),
    *(_numbered(f, _BOOKS) for f in ("{}. ", "#{} ")),
    *(_lines(m, _TASKS) for m in ("* ", "[x] ", "- ")),
    *(_lines(m, _BIRDS) for m in ("• ", "- ")),
    *(_lines(m, _GERMAN) for m in ("- ", "* ")), _numbered("{}. ", _FRENCH), _lines("- ", _FRENCH),
    "What to bring:\n\n" + _lines("- ", _PACKING),
    "The following books were returned last week and can be borrowed again from Monday on.\n\n" + _numbered("{}. ", _BOOKS + "/Emma/Nostromo/The Waves/Kim/Silas Marner"),
    "Name: Ada Novak\nBorn: 4 May 1961\nProfession: surveyor\nLanguages: Czech, English\nHobbies: chess, swimming\nStatus: retired",
    "Mon: soup and bread\nTue: baked potatoes\nWed: leftovers\nThu: fish with peas\nFri: pizza\nSat: out\nSun: roast",
    "Drinks\n- tea\n- lemonade\n- stout\n\nSnacks\n- crisps\n- olives\n- nuts\n\nSweets\n- fudge\n- toffee",
    _lines("- ", "Open the valve slowly, and wait until the hissing stops./Write down the pressure that the dial shows./Close the valve again./Repeat this three times, with a pause of a minute./Report any value above six bar./Lock the cabinet."),
    _lines("→ ", _TASKS), _lines("  - ", _SHOPPING), _numbered("Step {}: ", _STEPS),
)

_GRID = [["city", "country", "people", "founded"], ["Leiden", "NL", "124000", "860"], ["Ghent", "BE", "265000", "650"], ["Lund", "SE", "94000", "990"], ["Pisa", "IT", "90000", "180"], ["Jena", "DE", "110000", "1182"], ["Braga", "PT", "193000", "20"]]
_SCORES = [["run", "loss", "acc", "time_s", "gpu"], *[[f"r{i:02d}", f"{2.1 - i / 9:.3f}", f"{50 + i * 1.7:.1f}", str(300 + 7 * i), "a" if i % 2 else "b"] for i in range(12)]]
_PARTS = [["part", "material", "price", "note"], ["hinge", "steel", "2.40", "needs two screws"], ["handle", "brass", "7.10", "left or right"], ["panel", "oak", "31.00", "cut to size"], ["dowel", "beech", "0.15", "sold in tens"], ["glue", "resin", "4.90", "dries in an hour"]]
_TIMES = [["line", "from", "to", "dep", "arr"], *[[str(i), a, b, f"{6 + i:02d}:15", f"{7 + i:02d}:02"] for i, (a, b) in enumerate((("Bath", "Wells"), ("Wells", "Frome"), ("Frome", "Bruton"), ("Bruton", "Castle Cary"), ("Castle Cary", "Yeovil")), 1)]]


def _joined(grid: list[list[str]], sep: str) -> str:
    return "\n".join(sep.join(r) for r in grid)


def _padded(grid: list[list[str]]) -> str:
    w = [max(len(r[j]) for r in grid) for j in range(len(grid[0]))]
    return "\n".join("  ".join(x.ljust(n) for x, n in zip(r, w)).rstrip() for r in grid)


def _marked(grid: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [grid[0], ["---"] * len(grid[0]), *grid[1:]])


def _ruled(grid: list[list[str]]) -> str:
    w = [max(len(r[j]) for r in grid) for j in range(len(grid[0]))]
    rule = "+" + "+".join("-" * (n + 2) for n in w) + "+"
    return "\n".join([rule, *("| " + " | ".join(x.ljust(n) for x, n in zip(r, w)) + " |" for r in grid), rule])


TABLE = tuple(f(g) for g in (_GRID, _SCORES, _PARTS, _TIMES) for f in (lambda g: _joined(g, ","), lambda g: _joined(g, ";"), lambda g: _joined(g, "\t"), lambda g: _joined(g, " | "), _padded, _marked, _ruled)) + (
    "Departures of this week, as far as they are known:\n\n" + _marked(_TIMES + _TIMES[1:]),
    "Results\n\n" + _padded(_SCORES),
)

_MENU = "Home / About us / Products / Cart (0) / Login / Register / FAQ / Imprint / Privacy / Cookies / Newsletter / Follow us / Sitemap / Top".split(" / ")
_HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
_B64 = "TG9yZW0gaXBzdW0gZG9sb3Igc2l0IGFtZXQsIGNvbnNlY3RldHVyIGFkaXBpc2Npbmc="
_SENT = "Please enable JavaScript to view this page."
_WORDS = "copper window Tuesday slowly beneath marble although ticket gravel violin seven harbour melt quietly".split()
JUNK = (
    " | ".join(_MENU), "\n".join(_MENU), " · ".join(_MENU * 2), "  ".join(_MENU), "\n".join([_SENT] * 12), " ".join([_SENT] * 9), "\n\n".join(["Page not found."] * 15),
    _HEX * 8, "\n".join([_HEX] * 10), "\n".join(_B64[i:] + _B64[:i] for i in range(12)), _B64 * 6,
    "asdf jkl asdf qwer zxcv uiop asdf hjkl qwer asdf zxcv bnm qwer asdf jkl uiop zxcv asdf qwer hjkl bnm asdf",
    "xkq vbz wrtp lmnh qqz ptk zzv bnmk wxr tqp hjk vvb zxq wpl mnb rtk qzx plk vbn wqx",
    "#### %%%% ~~~~ ^^^^ ||||| <<<>>> @@@ &&& $$$ ### %%% ~~~ ^^^ |||| <<>> @@ && $$ ## %% ~~ ^^",
    "�� T�e r�p�rt w�s n�t r��d�ble, b�c�use th� fil� h�d b��n s�v�d w�th th� wr�ng c�d� p�ge � �nd n�b�dy n�t�ced �t f�r w��ks.",
    "T#e m@rk&t op~ns a% s|x, b^t th* f%rst b@y#rs c&me at f$ve; by n|ne m^st of th~ go%ds ar# g*ne an@ th& st|lls st^nd em~ty.",
    "test " * 60, "\n".join(["null"] * 40), "loading... " * 30, "blah blah " * 40, "click here " * 35, "0 " * 120,
    " ".join(_WORDS[(i * 5 + i // 3) % 14] for i in range(90)), " ".join(sorted(_WORDS * 6)), " ".join(_WORDS[::-1] * 5),
    " ".join(w[::-1] for w in "the letters of every single word in this sentence have been turned around so that nobody can read what it once said about the weather in the north".split()),
    "\n".join(f'<li class="nav-{i}"><a href="/p/{i}?ref=top">{m}</a></li>' for i, m in enumerate(_MENU)), "".join(f"<td>{i}</td><td></td>" for i in range(60)),
    "{{header}} {{nav}} {{#if user}} {{user.name}} {{/if}} {{body}} {{footer}} {{scripts}} {{#each items}} {{this}} {{/each}} {{analytics}} " * 3,
    "BUY NOW!!! CHEAP!!! CLICK!!! FREE!!! BUY NOW!!! CHEAP!!! CLICK!!! FREE!!! WIN!!! BUY NOW!!! CHEAP!!! CLICK!!! FREE!!! WIN WIN WIN!!!",
    "", "   \n\n  ", "....................", "-----=====-----=====-----=====", "Read more Read more Share Tweet Pin Share Tweet Pin Read more Subscribe Share Tweet Pin Read more Subscribe now Share",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890" * 30, "lorem " * 50,
    "function(){var a=b[c];d=e?f:g;return h(i,j)};function(){var k=l[m];n=o?p:q;return r(s,t)};" * 4, "&nbsp;&nbsp;&amp;&lt;&gt;&quot;&nbsp;&copy;&nbsp;&raquo;&nbsp;" * 8,
)

TEXTS = tuple((t, k) for k, texts in (("prose", PROSE), ("list", LIST), ("table", TABLE), ("junk", JUNK)) for t in texts)
