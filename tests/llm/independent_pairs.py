"""Prompts and answers written by hand for the tests, without looking at any table: sound ones and one defect each.

The subjects, phrasings and layouts are not those of the training phrases of `evalanvil.llm.pairs`.
"""

# fmt: off
SOUND: tuple[tuple[str, str], ...] = (
    ("How do I get red wine out of a carpet?", "Blot it at once with a clean cloth, then pour on cold water and blot again. Salt draws out what is left overnight."),
    ("Name three rivers in Europe.", "The Danube, the Loire and the Vistula."),
    ("What is the capital of Kenya?", "Nairobi"),
    ("Give me a short poem about snow.", "Quiet roofs and quiet lanes,\nwhite on fences, white on panes;\nno one speaks and no one goes,\nonly listens while it snows."),
    ("Why does bread rise?", "Yeast feeds on the sugars in the flour and gives off carbon dioxide. The gluten in the dough holds the bubbles, so the loaf swells."),
    ("Is 91 a prime number?", "No. 91 = 7 × 13."),
    ("Explain what an index does in a database.", "An index is a sorted copy of one or more columns together with pointers to the rows. The database can search it instead of reading every row, at the price of slower writes."),
    ("Which planet is the largest? A) Mars B) Jupiter C) Venus D) Earth", "The largest planet in our system is Jupiter, with more than twice the mass of all others together.\n\nAnswer: B"),
    ("Solve 3x + 5 = 20.", "Subtract five from both sides: 3x = 15. Dividing by three gives\n\n\\boxed{5}"),
    ("Write a Python function that doubles a number.", "```python\ndef double(n):\n    return 2 * n\n```"),
    ("List the ingredients of a pancake.", "- flour\n- milk\n- two eggs\n- a pinch of salt"),
    ("Return a JSON object with a name and an age.", '{"name": "Ida", "age": 41}'),
    ("Write a polite note that turns down a dinner invitation.", "Dear Maya, thank you so much for thinking of me. Sadly I won't be able to come on Friday, as I'm already expected elsewhere. Have a lovely evening!"),
    ("Translate 'good night' into Italian.", "Buona notte."),
    ("Translate this sentence into French: The train is late again.", "Le train est encore en retard."),
    ("Describe your ideal weekend in two sentences.", "I'd sleep late, read on the balcony and walk to the lake. On Sunday some friends would come over and we'd cook together."),
    ("What can you tell me about cork?", "Cork is the bark of an oak that grows around the western Mediterranean. It is peeled every nine years or so, and the tree lives on."),
    ("I can't sleep. Any advice?", "I'm sorry to hear that. Keep the room cool and dark, leave the phone outside, and get up at the same hour every day. If it goes on for weeks, see a doctor."),
    ("How can't one love cats?", "Some people can't, and that's fine: cats scratch, shed and wake you at five."),
    ("Compare tea and coffee.", "Coffee usually has more caffeine per cup and acts faster. Tea has less, and its theanine makes the effect feel calmer."),
    ("Wie lange muss ein Ei kochen?", "Für ein weiches Ei reichen fünf Minuten, für ein hartes braucht es neun bis zehn."),
    ("Nenne zwei Gründe, warum Städte Bäume pflanzen.", "Bäume kühlen im Sommer die Straßen, weil sie Schatten geben und Wasser verdunsten. Außerdem halten sie Staub zurück."),
    ("Was bedeutet das Wort Feierabend?", "Es bezeichnet den Schluss der Arbeit am Ende des Tages und auch die freie Zeit danach."),
    ("Schreibe eine Absage an einen Bewerber.", "Sehr geehrter Herr Lang, vielen Dank für Ihre Bewerbung. Leider müssen wir Ihnen mitteilen, dass wir uns anders entschieden haben."),
    ("Pourquoi la mer est-elle salée ?", "Les rivières arrachent des sels aux roches et les portent jusqu'à la mer. L'eau s'évapore, mais le sel reste."),
    ("Donne-moi une recette simple avec des tomates.", "Coupez quatre tomates, ajoutez de l'huile, du sel et du basilic, puis laissez reposer dix minutes avant de servir."),
    ("Qu'est-ce qu'un solstice ?", "C'est le moment de l'année où le jour est le plus long ou le plus court."),
    ("¿Por qué el cielo es azul?", "La luz azul se dispersa en el aire mucho más que la roja, y por eso llega a nuestros ojos desde todas partes."),
    ("Dame un consejo para aprender a nadar.", "Empieza en agua poco profunda y aprende primero a respirar con calma. Lo demás llega con la práctica."),
    ("¿Cuántos lados tiene un hexágono?", "Seis."),
    ("Erkläre auf Englisch, was ein Kompass tut.", "A compass shows where magnetic north is. Its needle is a small magnet that turns until it lines up with the field of the earth."),
    ("Réponds en allemand : quel jour sommes-nous après lundi ?", "Nach Montag kommt Dienstag."),
    ("Summarise: the bridge was closed for a month because a ship had hit it.", "After a ship collided with it, the bridge stayed shut for a month."),
    ("Repeat after me: the sky is wide.", "The sky is wide. And here is a thought to go with it: nobody has ever seen its edge, because it has none."),
    ("Give the first five square numbers as CSV with a header.", "n,square\n1,1\n2,4\n3,9\n4,16\n5,25"),
    ("What's 12 % of 250?", "30"),
    ("When was the printing press invented?", "Around 1440, by Johannes Gutenberg in Mainz."),
    ("Should I learn Rust or Go first?", "If you mostly write network services, start with Go: you will be productive within a week. If you care about memory layout and speed, Rust pays off, though it takes longer."),
    ("Write a title for a story about a lighthouse.", "The Last Keeper Of Grey Rock"),
    ("How many legs has a spider?", "<think>Spiders are arachnids, so eight.</think>Eight legs."),
    ("Tell me a joke.", "Why did the scarecrow get a prize? Because he was outstanding in his field! 😄"),
    ("Show me a shell command that counts lines in a file.", "`wc -l notes.txt`"),
    ("Explain why I can't divide by zero.", "Because no number times zero gives anything but zero, there is no answer that could be checked by multiplying back."),
    ("What did the critics say about the play?", "\"I cannot praise it enough,\" wrote one; another was less kind and called the second act too long."),
    ("Give me a YAML file with two servers.", "servers:\n  - name: alpha\n    port: 80\n  - name: beta\n    port: 443"),
    ("Which is heavier, a litre of oil or of water?", "Water. Oil is less dense, and that is why it floats."),
    ("Write one sentence about hope.", "Hope is the habit of leaving a window open."),
    ("Name the four seasons, one per line.", "Spring\nSummer\nAutumn\nWinter"),
    ("How do vaccines work?", "They show the immune system a harmless part of a germ. The body learns to recognise it and answers faster when the real one comes."),
    ("Is it safe to eat snow?", "Fresh snow in clean air, a handful now and then: yes. Coloured snow or snow by a road: no."),
)

REFUSED: tuple[tuple[str, str], ...] = tuple(
    (SOUND[i % len(SOUND)][0] if lang == "en" else {"de": "Wie lange muss ein Ei kochen?", "fr": "Qu'est-ce qu'un solstice ?", "es": "Dame un consejo para aprender a nadar."}[lang], text)
    for i, (lang, text) in enumerate((
        ("en", "Sorry, that's not something I'm going to do."),
        ("en", "I'm not comfortable answering that question, so I'll leave it there."),
        ("en", "I can't provide that information."),
        ("en", "That falls outside of what I can assist with. Is there something else you need?"),
        ("en", "As a language model I am not permitted to respond to this kind of prompt."),
        ("en", "I won't be answering this one."),
        ("en", "I'm unable to fulfill this request because it conflicts with my guidelines."),
        ("en", "No. I refuse to take part in this."),
        ("en", "Unfortunately I can't comply with your request. Please contact a professional instead."),
        ("en", "It would not be appropriate for me to answer, so I must decline."),
        ("en", "I appreciate you asking, but I have to say no to this request."),
        ("en", "My apologies, but I'm not allowed to help with this."),
        ("en", "I don't think I should answer that. Let's talk about something different."),
        ("en", "Answering this would go against my policies, and I therefore cannot continue."),
        ("en", "I regret that I can't give you an answer to this."),
        ("en", "I'd prefer not to respond to this."),
        ("en", "This request can't be completed by me, sorry."),
        ("en", "Thanks for your message. After careful thought I have decided not to answer, because I cannot be sure how the answer would be used. I hope that you can accept this."),
        ("en", "I am declining this request."),
        ("en", "<think>Is this allowed? Probably not.</think>I'm sorry, but I can't assist with that."),
        ("de", "Das kann ich leider nicht beantworten."),
        ("de", "Es ist mir nicht erlaubt, auf diese Anfrage zu antworten."),
        ("de", "Ich möchte diese Frage lieber nicht beantworten. Bitte haben Sie dafür Verständnis."),
        ("de", "Diese Anfrage muss ich zurückweisen, da sie meinen Richtlinien widerspricht."),
        ("fr", "Je regrette, mais je ne peux pas donner suite à cette demande."),
        ("fr", "Il m'est impossible de répondre à cela."),
        ("fr", "Désolé, je ne suis pas autorisé à traiter ce sujet."),
        ("es", "Lo lamento, pero no puedo contestar a eso."),
        ("es", "No me está permitido ayudar con esta solicitud."),
        ("es", "Prefiero no responder. Por favor, pregunte otra cosa."),
    ))
)

COPIED: tuple[tuple[str, str], ...] = (
    ("How do I get red wine out of a carpet?", "How do I get red wine out of a carpet?"),
    ("How do I get red wine out of a carpet?", "how do i get red wine out of a carpet"),
    ("How do I get red wine out of a carpet?", "The question is: How do I get red wine out of a carpet?"),
    ("Explain what an index does in a database.", "Explain what an index does in a database."),
    ("Explain what an index does in a database.", "EXPLAIN WHAT AN INDEX DOES IN A DATABASE."),
    ("Explain what an index does in a database.", "**Explain what an index does in a database.**"),
    ("Write a polite note that turns down a dinner invitation.", "Write a polite note that turns down a dinner invitation"),
    ("Write a polite note that turns down a dinner invitation.", "Sure. Write a polite note that turns down a dinner invitation."),
    ("Write a polite note that turns down a dinner invitation.", "> Write a polite note that turns down a dinner invitation."),
    ("Compare tea and coffee in three short sentences for a school newspaper.", "Compare tea and coffee in three short sentences for a school paper."),
    ("Compare tea and coffee in three short sentences for a school newspaper.", "Compare coffee and tea in three short sentences for a school newspaper."),
    ("Compare tea and coffee in three short sentences for a school newspaper.", "You asked me to compare tea and coffee in three short sentences for a school newspaper."),
    ("Which planet is the largest? A) Mars B) Jupiter C) Venus D) Earth", "Which planet is the largest? A) Mars B) Jupiter C) Venus D) Earth"),
    ("Describe how a lock lifts a boat, and name one famous canal that has locks.", "Describe how a lock lifts a boat, and name one famous canal that has locks."),
    ("Describe how a lock lifts a boat, and name one famous canal that has locks.", "describe how a lock lifts a boat and name one famous canal that has locks"),
    ("Describe how a lock lifts a boat, and name one famous canal that has locks.", "how a lock lifts a boat, and name one famous canal that has locks."),
    ("Describe how a lock lifts a boat, and name one famous canal that has locks.", "```\nDescribe how a lock lifts a boat, and name one famous canal that has locks.\n```"),
    ("Wie lange muss ein Ei kochen, damit das Gelbe noch weich bleibt?", "Wie lange muss ein Ei kochen, damit das Gelbe noch weich bleibt?"),
    ("Wie lange muss ein Ei kochen, damit das Gelbe noch weich bleibt?", "Frage: Wie lange muss ein Ei kochen, damit das Gelbe noch weich bleibt?"),
    ("Nenne zwei Gründe, warum Städte Bäume pflanzen.", "nenne zwei gründe, warum städte bäume pflanzen"),
    ("Pourquoi la mer est-elle salée, et depuis quand le sait-on ?", "Pourquoi la mer est-elle salée, et depuis quand le sait-on ?"),
    ("Pourquoi la mer est-elle salée, et depuis quand le sait-on ?", "« Pourquoi la mer est-elle salée, et depuis quand le sait-on ? »"),
    ("¿Por qué el cielo es azul durante el día y rojo al atardecer?", "¿Por qué el cielo es azul durante el día y rojo al atardecer?"),
    ("¿Por qué el cielo es azul durante el día y rojo al atardecer?", "por qué el cielo es azul durante el día y rojo al atardecer"),
    ("Tell me about the three most common mistakes that beginners make when they learn to ski.", "Tell me about the three most common mistakes that beginners make when they learn to ski. Tell me about the three most common mistakes that beginners make when they learn to ski."),
    ("Tell me about the three most common mistakes that beginners make when they learn to ski.", "Tell me about the most common mistakes that beginners make when they learn how to ski."),
    ("Tell me about the three most common mistakes that beginners make when they learn to ski.", "<think>ok</think>Tell me about the three most common mistakes that beginners make when they learn to ski."),
    ("Tell me about the three most common mistakes that beginners make when they learn to ski.", '{"question": "Tell me about the three most common mistakes that beginners make when they learn to ski."}'),
    ("Write one sentence about hope that does not use the letter z.", "Write one sentence about hope that does not use the letter z."),
    ("Write one sentence about hope that does not use the letter z.", "Prompt: Write one sentence about hope that does not use the letter z."),
)

FOREIGN: tuple[tuple[str, str], ...] = (
    ("Why does bread rise?", "Die Hefe frisst den Zucker im Mehl und gibt dabei Gas ab. Der Teig hält die Blasen fest, und so geht das Brot auf."),
    ("Why does bread rise?", "La levure mange les sucres de la farine et produit du gaz, que la pâte retient."),
    ("Why does bread rise?", "La levadura se alimenta del azúcar de la harina y suelta gas; la masa lo retiene y el pan crece."),
    ("Why does bread rise?", "Il lievito si nutre degli zuccheri della farina e produce gas, che resta nella pasta e la fa crescere."),
    ("Why does bread rise?", "De gist eet de suikers uit het meel en maakt gas, dat in het deeg blijft zitten."),
    ("Why does bread rise?", "O fermento come o açúcar da farinha e solta gás, que fica preso na massa."),
    ("Why does bread rise?", "Дрожжи питаются сахаром и выделяют газ, поэтому тесто растёт."),
    ("Why does bread rise?", "酵母は糖を食べてガスを出します。だから生地がふくらみます。"),
    ("Why does bread rise?", "酵母吃掉面粉里的糖，放出气体，所以面团会变大。"),
    ("Why does bread rise?", "Η μαγιά τρώει τα σάκχαρα και βγάζει αέριο."),
    ("Why does bread rise?", "Jästen äter sockret i mjölet och ger ifrån sig gas, som stannar kvar i degen så att brödet växer."),
    ("Why does bread rise?", "Kvasnice se živí cukrem z mouky a vytvářejí plyn, který těsto udrží, a proto chléb naroste."),
    ("Explain what an index does in a database.", "Ein Index ist eine sortierte Kopie einer Spalte. Damit findet die Datenbank eine Zeile, ohne alle zu lesen."),
    ("Explain what an index does in a database.", "Un index est une copie triée d'une colonne ; la base y cherche au lieu de lire toutes les lignes."),
    ("Explain what an index does in a database.", "Un índice es una copia ordenada de una columna, y la base busca en ella en lugar de leer todas las filas."),
    ("Explain what an index does in a database.", "Of course, here you go: un indice è una copia ordinata di una colonna, con cui il database trova le righe senza leggerle tutte."),
    ("How do vaccines work?", "Sie zeigen dem Körper einen harmlosen Teil des Erregers, damit er ihn später schneller erkennt."),
    ("How do vaccines work?", "Ils montrent au corps une partie inoffensive du microbe, pour qu'il le reconnaisse plus vite ensuite."),
    ("Was bedeutet das Wort Feierabend?", "It means the end of the working day, and also the free time that follows it."),
    ("Was bedeutet das Wort Feierabend?", "C'est la fin de la journée de travail et le temps libre qui la suit."),
    ("Was bedeutet das Wort Feierabend?", "Es el final de la jornada y también el tiempo libre que viene después."),
    ("Nenne zwei Gründe, warum Städte Bäume pflanzen.", "Trees cool the streets in summer because they give shade, and they also hold back the dust."),
    ("Pourquoi la mer est-elle salée ?", "Rivers wash salts out of the rocks and carry them to the sea. The water evaporates, but the salt stays."),
    ("Pourquoi la mer est-elle salée ?", "Die Flüsse waschen Salz aus den Steinen und tragen es ins Meer; das Wasser verdunstet, das Salz bleibt."),
    ("Qu'est-ce qu'un solstice ?", "Es el momento del año en que el día es más largo o más corto."),
    ("¿Por qué el cielo es azul?", "Blue light is scattered by the air much more than red light, so it reaches our eyes from everywhere."),
    ("¿Por qué el cielo es azul?", "Das blaue Licht wird von der Luft viel stärker gestreut als das rote."),
    ("Dame un consejo para aprender a nadar.", "Commencez dans une eau peu profonde et apprenez d'abord à respirer avec calme."),
    ("Erkläre auf Englisch, was ein Kompass tut.", "Une boussole montre où se trouve le nord. Son aiguille est un petit aimant qui tourne."),
    ("Translate this sentence into French: The train is late again.", "Der Zug hat schon wieder Verspätung, und niemand weiß warum."),
)

CUT: tuple[tuple[str, str], ...] = (
    ("Why does bread rise?", "Yeast feeds on the sugars in the flour and gives off carbon diox"),
    ("Why does bread rise?", "Yeast feeds on the sugars in the flour and gives off carbon dioxide. The gluten in the"),
    ("Why does bread rise?", "Yeast feeds on the sugars in the flour, which"),
    ("How do I get red wine out of a carpet?", "Blot it at once with a clean cloth, then pour on cold"),
    ("How do I get red wine out of a carpet?", "First of all, don't panic. Blot it at once with a clean cloth, then pour on cold water and"),
    ("Explain what an index does in a database.", "An index is a sorted copy of one or more columns together with poin"),
    ("Explain what an index does in a database.", "An index is a sorted copy of one or more columns together with pointers to the"),
    ("Explain what an index does in a database.", "An index is a sorted copy of columns. There are two main kinds:\n\n1. B-trees, which keep the keys in order\n2. Hash indexes, which"),
    ("List the ingredients of a pancake.", "Here is what you need for eight pancakes:\n\n- 250 g of flour\n- half a litre of milk\n- two eggs, beaten with a pinch of"),
    ("Return a JSON object with a name and an age.", '{"name": "Ida", "ag'),
    ("Return a JSON object with a name and an age.", '{"people": [{"name": "Ida", "age": 41}, {"name": "Bo",'),
    ("Write a Python function that doubles a number.", "```python\ndef double(n):\n    \"\"\"Returns twice"),
    ("Write a Python function that doubles a number.", "Here is the function that you asked for:\n\n```python\ndef double(n):\n    return 2 *"),
    ("Give the first five square numbers as CSV with a header.", "n,square,cube\n1,1,1\n2,4,8\n3,9,"),
    ("Compare tea and coffee.", "Coffee usually has more caffeine per cup and acts faster. Tea has less, and its theani"),
    ("Compare tea and coffee.", "Coffee usually has more caffeine per cup and acts faster. Tea, on the other hand, has less of it and"),
    ("How do vaccines work?", "<think>The user wants a short explanation. I should mention memory cells and"),
    ("How do vaccines work?", "<think>First the antigen, then the response. Keep it simple."),
    ("How do vaccines work?", "They show the immune system a harmless part of a germ. The body learns to recogn"),
    ("What can you tell me about cork?", "Cork is the bark of an oak that grows around the western Mediterranean. It is peeled every nine years or so, and the"),
    ("What can you tell me about cork?", "Cork is the bark of an oak that grows around the western Mediterranean. \"It is peeled"),
    ("Give me a short poem about snow.", "Quiet roofs and quiet lanes,\nwhite on fences, white on panes;\nno one speaks and no one"),
    ("Wie lange muss ein Ei kochen?", "Für ein weiches Ei reichen fünf Minuten, für ein har"),
    ("Wie lange muss ein Ei kochen?", "Für ein weiches Ei reichen fünf Minuten, für ein hartes braucht es neun bis"),
    ("Nenne zwei Gründe, warum Städte Bäume pflanzen.", "Bäume kühlen im Sommer die Straßen, weil sie"),
    ("Pourquoi la mer est-elle salée ?", "Les rivières arrachent des sels aux roches et les portent jusqu'à la"),
    ("Pourquoi la mer est-elle salée ?", "Les rivières arrachent des sels aux roches et les por"),
    ("¿Por qué el cielo es azul?", "La luz azul se dispersa en el aire mucho más que la"),
    ("¿Por qué el cielo es azul?", "La luz azul se dispersa en el aire mucho más que la roja, y por eso lle"),
    ("Should I learn Rust or Go first?", "If you mostly write network services, start with Go: you will be productive within a week. If you care about memory layout �"),
)

BLANK: tuple[tuple[str, str | None], ...] = tuple(
    ("Why does bread rise?", t)
    for t in (
        "", " ", "\n", "\t \n", "​", "﻿", "  ", "...", "-", "* * *", "---", "```\n```", "```json\n```", "``` \n\n\n```", "<think>Yeast, sugar, gas.</think>", "<think>Yeast.</think>\n\n",
        "Let me see. Yeast, sugar, gas.</think>", "[THINK]Yeast[/THINK] ", "analysisYeast makes gas.assistantfinal", "<|channel|>analysis<|message|>Yeast.<|end|><|start|>assistant<|channel|>final<|message|>", "⁠​ ‎", '""', "_", "\r\n\r\n", None,
    )
)

PAIRS = {"": SOUND, "refusal": REFUSED, "copy": COPIED, "language": FOREIGN, "truncated": CUT, "empty": BLANK}
