"""Words and phrases of abuse by class, and the cues that weigh them, in English, German, French and Spanish.

Fixed values, written from general knowledge of the languages. Entries of several words are parted by commas.
"""

from __future__ import annotations


def _all(text: str) -> list[str]:
    return [" ".join(x.split()) for x in text.split(",") if x.strip()]


INSULT = (
    """idiot idiots moron morons imbecile imbeciles cretin cretins fool fools halfwit halfwits dimwit dimwits dumbass dumbasses asshole assholes
arsehole arseholes bastard bastards bitch bitches scum scumbag scumbags fraud frauds liar liars loser losers maggot maggots worm cockroach clown clowns
coward cowards charlatan charlatans prick pricks twat twats wanker wankers freak freaks degenerate degenerates pervert perverts pig pigs swine rat
simpleton simpletons nitwit numbskull shithead shitheads dickhead dickheads motherfucker motherfuckers douchebag jackass lowlife nobody scoundrel creep
parasite parasites vermin trash garbage filth retard retards retarded cripple cripples spastic mongoloid dyke dykes sexist hypocrite dunce blockhead cunt cunts slut sluts whore whores
idioten vollidiot vollidioten schwachkopf trottel dummkopf abschaum versager lügner ratte drecksau drecksack dreckskerl wurm arschloch dreck null
arschlöcher missgeburt schlampe hure wichser penner ungeziefer parasit schwein hurensohn nichtsnutz spast
crétin crétins connard connards abruti abrutis imbécile imbéciles raté ratés déchet déchets vermine menteur menteurs ordure ordures salaud salope salopes
minable minables enculé bouffon débile porcherie raclure con conne cons nul nuls nulle honte
gusano gusanos rata ratas idiota idiotas imbécil imbéciles inútil inútiles escoria mentiroso mentirosa mentirosos basura cabrón cabrona cabrones
gilipollas fracasado fracasada fracasados estúpido estúpida estúpidos pendejo maricón payaso payasa parásito vergüenza zorra""".split()
    + _all("piece of shit, pieces of shit, load of shit, load of crap, load of garbage, waste of space, waste of skin, son of a bitch, pedazo de mierda, pauvre type, letzter dreck, hijo de puta, tas de merde, haufen versager, stück scheiße")
)
SCORN = """stupid worthless useless pathetic disgusting repulsive miserable spineless brainless filthy goddamn fucking fucked damned vile dumb subhuman
braindead shitty dirty moronic idiotic
dreckig dreckige dreckiger widerlich widerliche erbärmlich erbärmliche dumme dummer blöde blöder
sale pourri pourrie stupide répugnant répugnante
asqueroso asquerosa asquerosos miserable maldito maldita""".split()
CRUDE = """fuck fucks shit bullshit dick cock tits pussy cum ass arse crap
fresse ficken scheiße scheisse maul schnauze
gueule merde pute putain foutre
mierda puta follar coño""".split()
#: Names for groups whose only use is contempt.
SLUR = """nigger niggers nigga faggot faggots fag fags kike kikes spic spics chink chinks gook gooks wop wops wetback wetbacks raghead ragheads towelhead
paki pakis tranny trannies
kanake kanaken neger schwuchtel schwuchteln zigeuner judensau
bougnoule bougnoules négro négros pédé pédés youpin youpins
sudaca sudacas maricones moromierda""".split()
#: What a threat does.
HARM = (
    """kill hurt burn break smash shoot strangle ruin hunt beat bleed destroy murder stab crush choke hang drown whip maim bury rape punch slap
fertigmachen vernichten umbringen töten zerstören brechen schlagen verprügeln erledigen zerquetschen aufschlitzen
casser démolir tuer crever détruire frapper massacrer égorger
romper destrozar matar arruinar reventar aplastar""".split()
)
#: The same, if it is done to you; otherwise ordinary verbs.
HARM_YOU = "find cut hit kick regret pay cry beg scream crawl suffer finden kriegen payer encontrar pegar partir hundir sufrir".split()
#: What is wished on someone.
HARMED = (
    """beaten shot dragged hanged hung whipped drowned burned burnt strangled flogged binned gassed exterminated stabbed lynched
erschossen erschlagen vergast aufgehängt verprügelt pendus fusillés gazés fusilados ahorcados""".split()
    + _all("put down, left to rot, kicked out, spat on")
)
#: The same, after a word that wishes it.
DYING = "die died dead rot drown choke choked vanish vanished disappear disappeared abort aborted suffer hang burn".split() + _all("drop you, dropped you, smother you, smothered you")
#: Where a threatened person ends.
PLACE = "ambulance hospital wheelchair coffin morgue grave stretcher krankenhaus sarg grab ambulance cercueil tombe hospital ataúd tumba".split() + _all("body bag, intensive care")
GROUP = (
    """women men girls foreigners immigrants migrants refugees mothers muslims jews christians blacks whites arabs asians africans gays lesbians homosexuals gypsies negroes
mexicans romanians poles turks indians chinese pakistanis
frauen ausländer ausländerinnen flüchtlinge alte schwule behinderte mütter juden muslime türken araber migranten
femmes étrangers étrangères vieux vieilles immigrés réfugiés homosexuels handicapés mères juifs musulmans arabes noirs
mujeres extranjeros extranjeras viejos viejas inmigrantes refugiados refugiadas gays discapacitados discapacitadas negros negras moros gitanos judíos""".split()
    + _all("people from, people of, people like, those people, these people, such people")
)
#: Words that make a group of the noun of many behind them.
GROUP_OF = "gay lesbian trans disabled muslim jewish black brown asian african arab foreign immigrant old elderly single homeless poor fat schwule behinderte ausländische alte arme".split()
#: Nouns that, said of a group, deny its worth.
BASE = (
    """subhuman subhumans animals animal vermin parasites parasite rats cockroaches filth scum trash garbage thieves criminals liars rapists savages monkeys apes dogs pigs maggots disease plague
cancer pest abschaum ungeziefer dreck tiere parasiten vermine animaux parasites racaille rats basura escoria animales ratas ladrones parásitos""".split()
    + _all("a disease, a plague, a cancer, a pest")
)
#: What contempt says a group does or lacks.
CONTEMPT = (
    _all(
        """too dumb, too stupid, too thick, too lazy to, breed like, breed and, lie and steal, lie and cheat, steal and lie, only lie, only steal, ruin everything, spoil everything, no place among, belong in a cage, belong in a zoo, belongs nowhere,
belong nowhere, belong in the kitchen, never trust, cannot be trusted, only good for, are good for nothing, too emotional, should be grateful, decent people,
kein hirn, kein gehirn, kein recht, nichts verloren, nichts zu suchen, zu dumm, an den herd, in die küche, keinen verstand, taugen nichts,
pas de cerveau, ne servent à rien, servent à rien, à la cuisine, bons à rien, pas leur place, ont rien, trop bêtes, bons qu'à,
no tienen cerebro, no sirven, no valen, no deberían pisar, no deberían estar, no deberían opinar, no merecen, no saben pensar, a la cocina, son tontas, son tontos"""
    )
)
#: What is demanded to be done with people.
EXPEL = _all(
    """driven out, kept out, sent back, sent home, locked away, locked up, put on a train, put on trains, thrown out, wiped out, deported, sterilised, sterilized, caged, kept in cages, gassed, shot, rounded up, put down,
weggesperrt, abgeschoben, rausgeworfen, hinausgeworfen, eingesperrt, vergast, raus,
dégager, jetés dehors, jetées dehors, expulsés, enfermés, rentrer chez, rester à la cuisine,
expulsados, encerrados, echados, volver a su país"""
)
SEXUAL = (
    """tits ass pussy naked nude nudes horny fuck fucking lick suck sucking dick cock cum sexy titten arsch nackt ficken muschi blasen cul baiser sucer tetas culo desnuda follar chupar coño
spreading undress undressed""".split()
)
#: Words of bodies, which take two or a request to be sexual.
BODY = "knees tongue legs breasts breast body underwear bed bend bent strip thighs nipples wet hard moan ausziehen seins nue photos pictures skirt lips".split()
#: The same, if it is done to you.
SEXUAL_YOU = "screw ride taste bend touch undress have do".split()
ASKED = _all("show me, send me, let me see, keep thinking about you, keep thinking of you, dream about you, dream of you, fantasise about you")
#: Phrases that abuse by themselves if someone is meant (YOU or PERSON near), and what they count.
AIMED: dict[str, float] = dict.fromkeys(
    _all(
        """know where you live, know where you work, know where you park, know where you sleep, know your address, watch your back, kill yourself, hang yourself, drown yourself, shoot yourself, drop dead,
go to hell, rot in hell, burn in hell, end your life, end it all, want you dead, wish you were dead, hope you die, hope you rot, hope you get cancer, better off dead, make you bleed, make you suffer, make you pay, make you regret, leave in an ambulance,
world a favour, world a favor, us all a favour, us all a favor, everyone a favour, everyone a favor, worse for having, poorer for having, better off without, better place without, be better without,
would weep if you, would notice if you, would miss you, would care if you, would cry if you, dance on the grave, dance on your grave, spit on your grave,
should have been aborted, should have swallowed, had never been born,
niemand will dich, niemand will euch, niemand will sie hier, personne ne veut de toi, personne ne veut de vous, nadie te quiere, nadie os quiere, nadie la quiere, nadie lo quiere,
halt die fresse, halt dein maul, halt die schnauze, halten sie die fresse, halten sie ihr maul, fermez votre gueule, fermez vos gueules, ferme ta gueule, ta gueule, cierra el pico, cierra la boca, cállate, muérete, lárgate, va te faire, vai te faire, verpiss dich, fahr zur hölle,
fuck you, fuck off, piss off, screw you, so hard for you, so wet for you, hard for you, wet for you, tongue all over you, your tits, your ass, your pussy, suck my, lick my, sit on my, bend over for, come to my room, spread your legs, show me your body, show me your tits, show me your ass, send me nudes"""
    ),
    1.3,
) | dict.fromkeys(_all("get lost, shut up, go back to school"), 0.6)
#: Phrases that say what a person is good for.
USED = _all("only good for, good for nothing but, all she is good for, sleeps with, slept her way")

YOU = "you u yourself yourselves ya du dich dir ihr euch vous toi tu te t' usted ustedes tú ti vosotros os eres".split()
YOURS = "your yours dein deine deiner deinen euer eure ton ta tes votre vos tus vuestro vuestra".split()
PERSON = (
    """author authors reviewer reviewers editor editors referee referees expert experts colleague colleagues postdoc speaker student students whoever group lab team boss professor supervisor
him her them he she autor autoren gutachter gruppe auteur auteurs laboratoire équipe grupo autores revisor""".split()
    + _all("people like, sie sind, su grupo")
)
SELF = "i ich je yo".split() + _all("voy a")
INTENT = "will ll shall going want swear promise gonna werde werden vais voy quiero veux".split()
#: A wish of harm; and what makes one of a participle.
WISH = "deserve deserves deserved hope wish pity mérite verdient merece merecen".split() + _all("nobody would, no one would, want you, too good for")
SHOULD = "should ought must devraient devrait sollte sollten gehört gehören deberían debería deserve deserves deserved".split()
BE = "is are am was were be being re ist sind bist seid est sont es êtes eres son sois".split()
#: What may stand between a word of address and an insult.
FILL = """a an the such total complete absolute utter bloody little old big bunch pack sack load of and all just nothing but another real ein eine reiner der die das letzte letzter haufen ne un une des de d' ramassis banda espèce petit petite gros grosse vieux pura puro una unos
banda pedazo grand sucio so-called very most pauvre""".split()
DEAR = "dear hey only what such lieber liebe cher chère espèce querido".split() + _all("you are, you're")
#: Someone tells of words, animals, patients or a story here.
REPORT = """word words term terms annotator annotators annotated annotation post posts comment comments coded register registers transcript transcripts item items questionnaire questionnaires reported respondent
respondents participant participants interview interviews interviewee interviewees interviewer quote quoted quotes lexicon dictionary corpus labelled labeled classified phrase phrases slurs slur insult insults abusive abuse offensive tweet tweets
wörter wort begriff begriffe mot mots terme termes palabra palabras término términos diagnosis diagnosed patient patients clinic clinical clinics species plot plots plant plants animals ringed grazed surgery sample samples
novel film play poem chapter character characters novella drama story stage protagonist""".split()
#: Ordinary words one or two letters off a term.
ORDINARY = frozenset(
    """regard regards record records retired laser lasers lowers crowns crown whorls whorl creatin creatine creation mustard bitches discussing digesting regarded reward rewards cloned clowned idioms loses looser lovers losses towards
coward's parasitic parasitism filter filters impulsive useful frames morning shoot shot retarder infects maintain faults bladder""".split()
)
#: Insults that are mostly ordinary words: they need the word of address itself before them.
AMBIGUOUS = frozenset(
    """rat rats pig pigs swine worm null con cons conne nul nuls nulle honte parasite parasites garbage trash filth nobody creep spast parasit schwein ratte rata ratas gusano gusanos maggot maggots cockroach vermin
retarded cripple cripples spastic mongoloid dyke dykes freak freaks fraud frauds dirty miserable stupide basura vergüenza dick cock sale raté déchet déchets vermine zorra clown clowns sexist dunce""".split()
)
