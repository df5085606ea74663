"""Hand-checked texts with their kind, on which the probabilities of `quality` are calibrated.

Written by hand for this purpose; none comes from a corpus.
"""

# fmt: off
HOLDOUT: tuple[tuple[str, str], ...] = (
    ("The survey was closed on Friday. Most of the answers came from people who had used the tool for a year, so we can't say much about new users.", "prose"),
    ("We met twice this month. At the first meeting we agreed on the list of models; at the second we looked at what had gone wrong with the scores.\n\nNobody had changed the prompts, but the parser had been updated in between.", "prose"),
    ("it rained all week and the harvest had to wait. by the time the sun came back, half of the barley had gone black, and the farmers were too tired to talk about it.", "prose"),
    ("Der Bericht ist fertig, aber niemand hat ihn gelesen. Am Montag sprechen wir noch einmal über die Zahlen, weil zwei davon nicht stimmen können.", "prose"),
    ("Le train est arrivé avec une heure de retard. Nous avons donc commencé sans les invités, et la discussion a duré jusqu'au soir.", "prose"),
    ("La reunión terminó antes de lo previsto. Después de comer, todos volvieron al taller y siguieron con el trabajo de la mañana.", "prose"),
    ("Only one thing matters here: the order of the rows must not change the result.", "prose"),
    ("# How the sample was drawn\n\nEvery id was hashed and the smallest hashes were kept. That way a second run gives the same sample, even if the rows arrive in another order.", "prose"),
    ("The old mill stands at the end\nof the village, where the road\nturns towards the river. Nobody\nhas lived there since the flood,\nbut the wheel still turns when\nthe water is high.", "prose"),
    ("To run it again, call the script with the new date:\n\n`score --date 2024-05-01 --all`\n\nIt takes about an hour. If it stops early, the log says which shard was missing, and you can start from there.", "prose"),
    ("Three things went wrong that day. The queue was full, the disk was slow and, worst of all, nobody noticed for six hours:\n\n- queue\n- disk\n- alarm\n\nSince then the alarm is tested every week, and somebody is always on call when a long run is started.", "prose"),
    ("Dear all, thank you for coming. I know that it was a long way for some of you, and I hope that the talks were worth it. We will send the slides next week.", "prose"),
    ("Accuracy fell from 61.2 to 58.9 after the change. That looks like a lot, but the interval is wide: with only 300 prompts, two points either way mean nothing.", "prose"),
    ("Why did the small model win? Because the large one wrote too much. Its answers were right, but they ended after the limit, and the grader never saw the last line.", "prose"),
    ("- milk\n- bread\n- two kilos of flour\n- salt\n- a bag of apples\n- candles", "list"),
    ("1. Open the lid\n2. Remove the filter\n3. Rinse with cold water\n4. Dry for an hour\n5. Close the lid", "list"),
    ("What we still need:\n\n* a name for the set\n* somebody to check the French prompts\n* more disk space\n* the final list of models\n* a date\n* a room\n* a projector", "list"),
    ("[ ] call the plumber\n[x] pay the rent\n[ ] book the train\n[ ] water the plants", "list"),
    ("apples\npears\nplums\nblackberries\nred currants\nquinces\nhazelnuts", "list"),
    ("name: harbour survey\nowner: the town\nyear: 1998\nplace: north pier\nstatus: closed", "list"),
    ("• der Hafen\n• die Mühle am Bach\n• das Rathaus\n• drei alte Brücken\n• der Markt", "list"),
    ("#1 la gare\n#2 le pont neuf\n#3 l'église\n#4 le marché\n#5 la bibliothèque", "list"),
    ("- The gate is closed at ten.\n- Dogs stay on the lead.\n- Nobody swims below the weir.\n- Fires need a permit.\n- The last bus leaves at nine.", "list"),
    ("a) red\nb) green\nc) blue\nd) none of these\ne) all of these\nf) don't know", "list"),
    ("name,score,rank\nalpha,71.2,1\nbeta,69.9,2\ngamma,64.0,3\ndelta,63.1,4", "table"),
    ("id;word;count;share\n1;water;40;0.4\n2;stone;31;0.31\n3;bread;29;0.29", "table"),
    ("| model | right | wrong |\n|---|---|---|\n| small | 120 | 80 |\n| medium | 141 | 59 |\n| large | 150 | 50 |", "table"),
    ("day\tmin\tmax\nMon\t4\t11\nTue\t6\t12\nWed\t3\t9\nThu\t2\t8", "table"),
    ("+------+-------+\n| town | count |\n+------+-------+\n| Ebb  | 12    |\n| Flow | 7     |\n+------+-------+", "table"),
    ("town      people  since\nEbb       1200    1820\nFlow      310     1904\nGreat Sea 88      1999\nLow Fen   41      1731", "table"),
    ("Results of the second run.\n\nfold,drift,tau,top\n1,1.2,0.93,5\n2,1.9,0.90,4\n3,1.1,0.95,5\n4,2.4,0.88,4\n5,1.6,0.91,5", "table"),
    ("the old pier | clay | 12.5\na small boat | wool | 3.0\nthe north wall | salt | 7.25\na narrow lane | bread | 1.5", "table"),
    ("Home  Login  Sign up  Contact  Terms  Privacy  Help  Next page  Previous  Share  Print  Back to top", "junk"),
    ("loading loading loading loading loading loading loading loading loading loading loading loading", "junk"),
    ("#@! %%& ^^* ~~ |>< =+_ $$# @@! <<>> &&^ %*# !!~ +=+ ##@ ^&* ~|~ <%> $!# @&*", "junk"),
    ("T#e h%rb~ur w#s cl~s%d a~d t#e sh%ps c~#ld n%t l~av# b%f~re th# st~rm h#d p%ss~d ov#r t%e isl~nd.", "junk"),
    ("eht dlo llim sdnats ta eht dne fo teh galiveL, erehw eht dora snrut sdrawot het virre nad bonody sah vidle heret", "junk"),
    ("The gate is closed at ten. The gate is closed at ten. The gate is closed at ten. The gate is closed at ten. The gate is closed at ten. The gate is closed at ten.", "junk"),
    ("weights token seed batch latency split panel token metric seed weights json drift batch latency panel split median", "junk"),
    ("4f9a02bc11de88ab73f0c5529e1d4a6690bb31fe2cd847a50f9e6b1c33d2a8e74f9a02bc11de88ab73f0c5529e1d4a66", "junk"),
    ("river the not because were stones had to when of mill a road nobody wheel the turned into and water under high", "junk"),
    ("xqv bnm tyr plk wsz edc rfv tgb yhn ujm ikl opz qaz wsx edc rfv tgb yhn", "junk"),
    ("Cookie notice · Login · Share · Terms · Download · Search · Menu · Settings · Home · Contact · Share · Login", "junk"),
    ("", "junk"),
)
