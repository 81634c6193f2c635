"""The grammar of abusive language: word classes, machines made of them, and rules with weights.

Notation of a pattern: lower case words stand for themselves, upper case names for a class, <name> for another machine,
``_`` for any word, ``^`` and ``$`` for the ends of the clause; (a | b), ?, *, + and {m,n} as usual.
"""

from __future__ import annotations

#: Words by class; a word may be in several. Folded: without accents, lower case.
CLASSES = {
    # insults that stand for a person, whoever says them
    "INSULT": """idiot idiots moron morons asshole assholes arsehole arseholes prick pricks dickhead dickheads retard retards imbecile imbeciles scumbag scumbags
        bastard bastards bitch bitches cunt cunts motherfucker motherfuckers fucker fuckers twat twats wanker wankers whore whores slut sluts dumbass dumbasses jackass dipshit dipshits
        shithead shitheads cretin cretins douchebag douchebags bellend tosser tossers dimwit dimwits halfwit halfwits nitwit dullard lowlife lowlifes sleazebag slimeball creep weirdo
        dumbfuck shitbag scumbucket dirtbag airhead blockhead bonehead plonker prat git gobshite tart bimbo arsewipe asswipe numbskull simpleton degenerate degenerates pervert skank hag knobhead pillock muppet
        idiota idiotas imbecil imbeciles gilipollas cabron cabrones pendejo pendejos subnormal subnormales capullo capullos
        puta putas puto putos malparido hijueputa huevon boludo pelotudo maricon maricones mamon baboso tarado tarada zorra mamarracho sinverguenza desgraciado desgraciada cretino
        burra burras burros otario otaria babaca babacas burro vagabundo vagabunda arrombado cuzao desgracado desgracada vadia corno palhaco canalha safado imbecis idiotas retardado merdinha
        arschloch arschlocher wichser hurensohn trottel dreckskerl vollidiot vollidioten fotze missgeburt schlampe drecksau spast schwachkopf mistkerl vollpfosten idioten hure""",
    # weaker ones, which need someone they are said of
    "MILD": """loser losers clown clowns scum parasite parasites pig pigs rat vermin trash liar liars thief thieves crook crooks coward cowards fool fools fraud hypocrite animal animals monster cow dog beast
        payaso payasos inutiles cobardes parasito estupido estupida rata escoria basura mentiroso mentirosa ladron ladrona cobarde cerdo cerda inutil
        porco lixo ladrao mentiroso mentirosa covarde verme schwein depp deppen penner abschaum lugner feigling dreck idiotin""",
    "FOUL": """corrupt greedy dishonest dumbest stupidest laziest drunken drunk hideous clumsy crazy stupid pathetic worthless useless disgusting brainless braindead greasy filthy spineless dumb ugly miserable fucking bloody damn goddamn rotten dirty little complete total absolute
        utter old fat sick vile nasty lying cheating thieving ignorant incompetent lazy slimy smelly stinking wretched gutless clueless miserable godforsaken cheap
        inutil asqueroso asquerosa maldito maldita puto puta repugnante estupido estupida miserable sucio sucia nojento nojenta imundo imunda inutil dumme dummes dummer blode blodes bloder verdammte verdammter dreckiges elende elender""",
    "YOU": "you u ya thou y0u",
    "PERSON": """landlord landlady tenant driver doctor nurse cop officer judge boss chief ceo cfo cto coo chairman chairwoman chair director manager analyst author writer editor journalist reporter columnist blogger minister president chancellor governor mayor senator politician
        banker broker trader adviser advisor teacher neighbour neighbor guy bloke man woman lady lad kid host owner founder moderator admin lawyer judge clerk secretary colleague intern
        jefe jefa director directora ministro ministra presidente presidenta periodista autor autora analista alcalde tipo tio tia gerente chefe diretor jornalista colega
        chef chefin minister kanzler vorstand autor journalist kollege kollegin nachbar typ mann frau""",
    "ONE": "immigrant migrant jew muslim gypsy black arab mexican foreigner refugee turk pole romanian indian homosexual african asian lesbian faggot",
    "GROUP": """women immigrants migrants refugees foreigners jews muslims blacks gays lesbians gypsies arabs asians mexicans africans christians homosexuals romanians poles turks indians pakistanis chinese roma
        albanians syrians kurds somalis nigerians latinos hispanics natives aboriginals transgenders transsexuals catholics protestants hindus sikhs buddhists atheists cripples
        mujeres inmigrantes refugiados refugiadas extranjeros extranjeras judios judias musulmanes musulmanas negros gitanos gitanas arabes homosexuales moros sudacas chinos rumanos discapacitados lesbianas migrantes
        mulheres imigrantes estrangeiros judeus muculmanos ciganos africanos indigenas deficientes homossexuais
        frauen auslander fluchtlinge juden muslime schwarze zigeuner turken araber behinderte schwule lesben migranten asylanten""",
    "GROUPADJ": """disabled gay lesbian trans transgender jewish muslim black brown roma romani arab asian mexican african foreign immigrant refugee indian chinese turkish polish homosexual queer native indigenous
        latino hispanic hindu christian catholic gypsy syrian nigerian pakistani kurdish autistic handicapped coloured colored""",
    "VERMIN": """vermin subhuman subhumans scum animals rats roaches cockroaches parasites filth trash garbage savages monkeys apes pigs inferior beasts disease plague leeches maggots lice degenerates
        animales ratas cucarachas basura plaga escoria inferiores bestias parasitos cerdos salvajes monos lixo ratos animais inferior pragas macacos ungeziefer abschaum tiere ratten untermenschen dreck affen parasiten schadlinge""",
    "HARM": "kill murder stab shoot beat smash break strangle burn slit hurt rape cripple hang drown punch choke gut bleed bury crush destroy skin slaughter butcher maim knife bash slap whip cut slice end finish",
    "HURTED": "killed murdered stabbed shot beaten strangled burned burnt hurt raped crippled hanged hung drowned punched gassed exterminated whipped slapped spat slaughtered executed lynched sterilised sterilized castrated deported eradicated erased",
    "WEAPON": "bullet knife blade gun axe fist brick hammer bomb rope shotgun",
    "LIMB": "head face neck throat chest skull back mouth teeth jaw legs arms bones knees nose ribs fingers heart eyes",
    "PLACE": "house home door family kids children school office work car mother wife daughter son street",
    "PORN": "porn porno pornos xxx milf milfs hentai blowjob blowjobs handjob handjobs creampie gangbang cumshot cumshots pussy pussies camgirl camgirls deepthroat orgasm orgasms dildo dildos onlyfans bukkake threesome masturbate masturbating masturbated jerked fellatio cunnilingus",
    "NUDE": "naked nude nudes undressed topless stripped desnuda desnudo desnudas desnudos nackt nackte nackten nua nu pelada pelado",
    "BODY": "pussy cock cocks tits dick dicks nipples nipple ass arse clit thighs breasts breast vagina penis panties boobs crotch bragas tetas culo polla cono verga coxas bunda buceta seios muschi schwanz titten erection groin",
    "PLEASURE": "panting gasping moaning groaning moaned panted gasped whimpering jadeando gimiendo gemia gimio gemendo gemia gemeu stohnend stohnte keuchend",
    "BED": "bed sofa couch desk table hotel sheets shower cama mesa escritorio sofa bett sabanas lencois",
    "MEDIA": "pics pictures videos video clips selfies cams cam photos fotos bilder livestream webcam webcams shows",
    "LEWD": "nude naked wet dirty xxx uncensored horny sexy desnuda desnudas sucias calientes hot explicit steamy",
    "TOUCH": "lick licked licks licking suck sucked sucks sucking fondle fondled squeeze squeezed squeezing stroke stroked stroking kiss kissed kissing finger fingered ride rode riding grab grabbed grabbing spread caress caressed rubbed rubbing tasted bit chupar lamer chupaba lamia besaba leckte lutschte lambeu lambia chupou",
    "THRUST": "thrust thrusts thrusting enfiou enfiava metia stiess rammte pushed slid slipped pounded pounding plunged entered penetrated rammed penetro meteu",
    "HIM": "her him me my his them you",
    "NEG": "not never no nor nt isn aren ain wasn weren don doesn nunca jamas nao nicht kein keine",
}

#: Machines that rules are composed of.
MACHINES = {
    "det": "(a | an | the | such | some | un | una | uno | um | uma | ein | eine | el | la | o | this | that | de | these | one | bunch of | pack of | a bunch of)",
    "insult": "(INSULT | son of a bitch | sons of bitches | piece of (shit | crap | garbage | trash | filth | work) | waste of (space | air | oxygen | skin) | sack of shit | load of shit | lump of shit | hijo de (la gran)? puta | hijos de (la gran)? puta"
    " | filho da puta | filha da puta | pedazo de (mierda | basura) | monte de merda | stuck scheisse | FOUL+ (MILD | VERMIN))",
    "are": "(are | re | r | were | is | s | was | son | sao | sind | ist | waren | will always be | have always been)",
    "much": "(all | just | nothing but | only | such | really | clearly | so | quite | still | always | todos | todas | alle | nur | unos | unas | una | un | una clase de | kinda | little more than | no better than | apenas | solo | FOUL)*",
    "group": "(the | those | these | all | most | los | las | esos | esas | estos | estas | die | diese | os | as | esses | alle | todos los | todas las | todos os)* (GROUP | (GROUPADJ | DEMONYM) (people | folk | folks | men | women | kids | families | workers) | people of colo(u)?r | DEMONYM)",
    "them": "(<group> | they | them | ellos | ellas | sie | eles | elas)",
    "will": "(will | shall | ll | am going to | m going to | gonna | going to | are going to | re going to | swear i will | swear i ll | want to | would love to | d love to | d like to | would like to | should | ought to | am about to)",
    "victim": "(you | your | u | ur | him | her | them | his | their | dich | euch | te)",
    "cast": "(thrown out | kicked out | wiped out | driven out | locked up | put (down | in (the | a)? <cage>) | banned from _ | kept (out | in (cages | camps | chains | their place) | away from _) | sent back | HURTED | removed from _ | rounded up)",
    "cage": "(cage | cages | camp | camps | the sea | bars | the ground | oven | ovens | zoo | zoos | the gutter | prison | chains | the kitchen | the jungle | the trees | the sewer | a cage | a zoo | a camp | gas chambers | jaulas | la jaula | carcel | la cocina | cozinha | die kuche | kuche | lager)",
}
MACHINES["group"] = MACHINES["group"].replace("people of colo(u)?r", "people of color | people of colour")

#: Kind, weight, pattern.
RULES = [
    # insults that are aimed at someone
    ("insult", 0.9, "YOU (are | re | were | r | will always be | is) <much> <det>? FOUL* <insult>"),
    ("insult", 0.7, "YOU (are | re | were | r) <much> <det>? FOUL* MILD"),
    ("insult", 0.7, "YOU (are | re | r) (so | such | too | just | really | all | as)* (fucking | bloody | damn | so | too)* (pathetic | worthless | disgusting | brainless | braindead | spineless | repulsive | retarded | stupid it hurts)"),
    ("insult", 0.9, "(eres | sos | sois | es usted | voce e | voces sao | tu es | du bist | ihr seid | sie sind) <much> <det>? FOUL* <insult>"),
    ("insult", 0.7, "(eres | sos | sois | voce e | tu es | du bist | ihr seid) <much> <det>? FOUL* MILD"),
    ("insult", 0.85, "(what | such) (a | an) FOUL* <insult>"),
    ("insult", 0.85, "(vaya | menudo | menuda | que | pedazo de | valiente | so) FOUL* <insult>"),
    ("insult", 0.9, "only (a | an) FOUL* <insult> like YOU"),
    ("insult", 0.85, "(run | led | managed | owned | headed | ruled | chaired | staffed | written) by <det>? FOUL* <insult>"),
    ("insult", 0.8, "his FOUL+ (friends | cronies | mates | gang) $"),
    ("insult", 0.85, "YOU FOUL* <insult> $"),
    ("insult", 0.85, "YOU FOUL+ (INSULT | MILD | VERMIN)"),
    ("insult", 0.85, "(du | tu | seu | sua | ihr) FOUL* INSULT"),
    ("insult", 0.85, "^ (listen | hey | oi | look | well | shut up | oye | mira | escucha | callate | cierra la boca | cala a boca | halt die fresse | halt die klappe | ey | bye | thanks | congratulations)+ up? YOU? FOUL* <insult>"),
    ("insult", 0.85, "^ FOUL* <insult> (vete | ojala | nadie | alguien | no sirves | callate | you | shut | fuck | go | die | i hope | nobody | someone)"),
    ("insult", 0.8, "<insult> de (mierda | puta madre | merda)"),
    ("insult", 0.85, "no sirves ni? para"),
    ("insult", 0.75, "(he | she | they | who | everyone | everybody | PERSON | PERSON and _{1,4}) (is | s | are | re | was | were | es | ist | e | son | sind) <much> <det>? FOUL* <insult>"),
    ("insult", 0.6, "(he | she | they | PERSON) (is | s | are | re | was | es | ist) <much> <det> FOUL* MILD and (a | an | un | una | ein | eine | um)? FOUL* MILD"),
    ("insult", 0.7, "YOU (people | lot | guys | two | all)+ are <much> <det>? FOUL* (INSULT | MILD)"),
    ("insult", 0.75, "(are | r) YOU <det>? FOUL* (retarded | stupid | dumb | braindead | INSULT)"),
    ("insult", 0.7, "only (a | an) FOUL* <insult> (would | could | can | buys | believes)"),
    ("insult", 0.7, "YOU MILD $"),
    ("insult", 0.8, "(scum of the earth | never met such (a | an) FOUL* INSULT | que asco de _)"),
    ("insult", 0.8, "(du | ihr) FOUL+ MILD"),
    ("insult", 0.7, "(at | by | with | about | to | is | ist | es) (that | this | the | der | die | das | el | la | ese | este) FOUL* INSULT (who | that | which | $)"),
    ("insult", 0.75, "(es | e | ist) (un | una | um | uma | ein | eine) FOUL* <insult>"),
    ("insult", 0.7, "(that | this | those | these | ese | esa | esos | este | dieser | dieses | esse | essa) FOUL* INSULT"),
    ("insult", 0.75, "(bunch | pack | gang | bando | hatajo | panda | pandilla | haufen) (of | de | von)? FOUL* (INSULT | MILD | VERMIN)"),
    ("insult", 0.9, "(shut (the | your) (fuck | hell | fucking mouth | mouth | face | trap) | fuck (off | you | yourself | your | him | her | them all) | go fuck | screw you | piss off | eat shit | kiss my ass | suck my dick | up yours | get stuffed)"),
    ("insult", 0.8, "(^ (just | so | now | and | please | you can)* go to hell | rot in hell | burn in hell | go to hell (you | and | with | $))"),
    ("insult", 0.85, "(vete | vayase | idos | andate | vai | va | vaya) (a | pra | para | tomar) (la | o)? (mierda | carajo | infierno | inferno | caralho | puta | no cu | merda)"),
    ("insult", 0.85, "(que (te | os | le | les) (jodan | follen | den) | a tomar por culo | fick dich | verpiss dich | leck mich am arsch | halt (die | deine) fresse | vai se (foder | ferrar) | vete al (infierno | carajo | diablo) | vai pro inferno | cala a boca _{0,2} INSULT | cierra (la | el) (puta | pico) boca?)"),
    ("insult", 0.8, "(callate _{0,12} mierda | choke on (your | it | that) | YOU deserve to (be | get) (HURTED | sacked and spat) | crawl back (in | into | in to | under))"),
    ("insult", 0.75, "(too | so) (stupid | dumb | thick | ignorant) (to | that) _{0,3} (breathe | live | read | count | tie | work | understand | you | spell)"),
    ("insult", 0.75, "YOU (have | ve | ve got | got) the (brain | brains | iq | intelligence | morals | face) of (a | an) _"),
    ("insult", 0.75, "(nobody | no one) (likes | loves | wants | needs | cares about) you"),
    ("insult", 0.75, "YOU (disgust | sicken | make) (me | us) (sick | puke | vomit | $)"),
    ("insult", 0.7, "(your | ur) (mother | mum | mom | wife | sister) is <det>? FOUL* (INSULT | pig | cow | dog)"),
    # wishes of death or harm
    ("harm", 0.85, "((nobody | no one) (would | will) (ever)? miss you | nadie te va a echar de menos | (world | place) would be (cleaner | better | happier) off? without you)"),
    ("harm", 0.9, "(i | we)? hope (you | he | she | they | (your | his | her | their) (kids | children | family | mother | wife | husband | mum)) (all | both)? (lose everything and rot | die ($ | in | of | soon | alone | slowly | painfully | screaming | today | like | and) | rot | get (cancer | shot | hurt | raped | aids | run over | hit by) | suffer | burn | choke | starve | bleed | drown | crash)"),
    ("harm", 0.9, "(ojala (te | se | os) (murais todos | atropelle | caiga | reviente | estrelles | parta un rayo | muera | mueras | mueran | pudra | pudras | pudran | ahogue | ahogues | maten | atropellen | quemen | parta | mate) | tomara que (voce | ele | ela)? (morra | morras | apodreca) | hoffentlich (stirbst | verreckst | krepierst) du)"),
    ("harm", 0.85, "((hole | ditch | hell | fire | gutter | corner) and die | (just | go | please) (die | kill yourself | hang yourself) | kill yourself | hang yourself | shoot yourself | kys | ^ die (in | you) | muerete | vai morrer | stirb | verrecke | morre)"),
    ("harm", 0.85, "(drink bleach | jump off a (bridge | cliff | roof) | slit your wrists | you should (die | be dead | kill yourself | have died | have been (aborted | drowned | shot)) | deserve to (die | suffer | burn | be dead))"),
    ("harm", 0.9, "(people | someone | somebody | thing | things | anyone | one | scum | women | men | types) like (you | him | her | them) should (not | never | nt) (be allowed | be permitted | have been | be able | exist | breathe | live | be alive)"),
    ("harm", 0.9, "(parents | mother | father | family | mum | mom | doctor) should have _? (drowned | left | thrown | aborted | strangled | killed | swallowed | sold | buried | abandoned) (you | him | her)"),
    ("harm", 0.8, "(do us all a (favour | favor) and (jump | die | leave | end | go | disappear) | ^ end it already | end your life | do the world a (favour | favor))"),
    ("harm", 0.9, "(i | we | i m | i am | ill) <will> _? HARM <victim>"),
    ("harm", 0.9, "(i | we | i m | they | you) <will> _? HARM (every | all | both | each)* (LIMB | bone | finger) (in | of) (your | his | her | their)"),
    ("harm", 0.9, "(i | we) <will> (find you and | come and | come over and | hunt you down and)? HARM _{0,2} (your | his | her) (LIMB | house down | car | family)"),
    ("harm", 0.9, "find you and _? HARM"),
    ("harm", 0.85, "(they | someone | somebody | he | we | i) (will | ll | should | needs to | need to | ought to) (kill | shoot | stab | murder | hang | beat | burn | strangle | slap | punch) (you | him | her | them | that (PERSON | INSULT))"),
    ("harm", 0.85, "hope (he | she | it | the PERSON | that PERSON) (dies | rots | suffers | burns | chokes | bleeds | drowns) ($ | in | slowly | soon | alone | painfully | like | today)"),
    ("harm", 0.85, "(the | this | that | these | those | whole | all) _ should (be | have been) (lynched | hanged | hung | gassed | beheaded | burned alive | burnt alive | raped)"),
    ("harm", 0.85, "(you | he | she | they) (deserve | deserves) to (be | get) HURTED"),
    ("harm", 0.85, "(he | she | you | they | PERSON) (should | ought to) (be | have been) HURTED"),
    ("harm", 0.85, "(someone | somebody | we | they | i | you) (ought to | should | must | need to | needs to | will | has to | have to) (kill | murder | stab | shoot | strangle | drown | hang | lynch | behead) (that | this | the | our | your)? FOUL* (PERSON | INSULT | whole family)"),
    ("harm", 0.9, "(i | we) <will> make (you | him | her | them) (bleed | suffer | pay in blood | scream | beg | regret being born | wish you were dead | disappear)"),
    ("harm", 0.9, "(put | putting | plant | ram | stick | shove | drive | bury) (a | an | this | my | the) WEAPON (in | into | through | to | down | between | up) <victim> (LIMB | eyes)?"),
    ("harm", 0.9, "(i | we) know (where | which | what) _{0,14} YOU _{0,14} (coming | come | bringing | bring | going to hurt | waiting | wait | hurt | WEAPON)"),
    ("harm", 0.85, "(i | we) know (where you (live | sleep | work | park) | where your (kids | children | family | wife | daughter | son | mother))"),
    ("harm", 0.85, "(we | i) (will | ll | are going to | m going to | are | am | m | re) (be)? (coming | waiting | come) for (you | your (family | kids | children))"),
    ("harm", 0.85, "(watch your back | you are dead | you re dead | you re a dead man | you are a dead man | dead man walking | your days are numbered | you will (regret | pay for) this with your life | sleep with one eye open | you won t (live | wake up | see tomorrow))"),
    ("harm", 0.85, "(someone | somebody | we | they) (ought to | should | must | need to | needs to | has to | have to) HARM <victim>"),
    ("harm", 0.85, "(alguien deberia (partirte | romperte | matarte | pegarte | reventarte | quemarte | arrancarte | cortarte) | alguem deveria te (matar | bater | quebrar))"),
    ("harm", 0.85, "((te voy a | vamos a | voy a | te vamos a) (matar | matarte | partir | partirte | romper | romperte | reventar | reventarte | quemar | quemarte | hacer sangrar | degollar | degollarte | pegar un tiro | cortar | arrancar | hacer dano) (te | la | el | los | las | tu | tus | a | $ | _))"),
    ("harm", 0.85, "(eu? vou (te | lhe) (encontrar e te)? (matar | quebrar | bater | arrebentar | estourar) | ich (werde | bring | bringe | mach | mache | schlage | schlag | steche | breche) (dich | dir | euch) _{0,4} (toten | schlagen | umbringen | um | fertig | tot | ab | schadel | knochen | zahne | kaputt) | wir (kriegen | finden | toten) dich | te (mato | rajo | reviento | parto la cara))"),
    ("harm", 0.8, "(^ (burn | smash | torch | wreck | bomb) their (shops | houses | homes | churches | mosques | temples | stores | villages) | ^ beat them (out | up | all | until) | ^ make them (pay in blood | bleed | suffer | disappear) | ^ (hang | shoot | kill | gas | deport | exterminate) them all? | lock them all up | (gas | hang | shoot | kill | exterminate | deport) them all)"),
    # attacks on groups
    ("hate", 0.9, "<them> <are> <much> VERMIN"),
    ("hate", 0.9, "no se _{1,3} son <much> VERMIN"),
    ("hate", 0.85, "<them> (viven | se comportan | live | behave | breed | crawl | crawl in | swarm | swarm in | multiply | leben | benehmen sich | vivem) (como | like | wie) VERMIN"),
    ("hate", 0.85, "<them> (are | re | son | sao | sind) (all | naturally)? (born (thieves | liars | criminals | killers | idiots | stupid) | too (stupid | dumb | lazy) by (birth | nature) | genetically (inferior | stupid) | not (real | really)? (people | human | humans) | less than human | a (disease | infestation | plague | cancer) | an infestation | una (enfermedad | plaga) | um cancer | eine (plage | seuche) | ruining our country | a stain on)"),
    ("hate", 0.85, "(no son (personas | humanos | gente | seres humanos) | nacen (ladrones | criminales | mentirosos | asesinos | inferiores) | traen enfermedades | sind keine menschen | nao sao (gente | pessoas | humanos) | sollten vergast werden | gehoren (vergast | ins lager | in die kuche | abgeschoben))"),
    ("hate", 0.9, "(they (all)? | <group> (all)?) (belong | belongs) (in | behind | under | back in) (the | a)? <cage>"),
    ("hate", 0.85, "<group> (do not | don t | dont | does not | should not | shouldn t | should never) (deserve _? (rights | right | vote | votes | account | accounts | job | jobs | live | mercy | home | homes | protection | citizenship | to live) | be allowed to (vote | breed | marry | work | drive | own | have (children | kids)) | have (rights | children | kids | the vote))"),
    ("hate", 0.9, "deserve _{0,2} (rights | right | vote | votes | account | accounts | job | jobs | live | mercy | home | homes | protection | citizenship) _{0,3} (belong | cages | camps | sea | prison | locked)"),
    ("hate", 0.85, "<group> _{0,5} (should | ought to | must | need to | deserve to | have to) (all)? be <cast>"),
    ("hate", 0.85, "(<group> _{0,4} (deberian | deben | tienen que) (ser)? (expulsados | exterminados | fusilados | encerrados | eliminados | deportados | morir | desaparecer) | (deveriam | devem) (ser)? (expulsos | exterminados | fuzilados | mortos | morrer))"),
    ("hate", 0.85, "(habria que | hay que | deberian | hemos de | toca) (echarlos | echarlas | encerrarlos | encerrarlas | expulsarlos | expulsarlas | matarlos | matarlas | quemarlos | quemarlas | fusilarlos | fusilarlas | exterminarlos | exterminarlas | desaparecer | deportarlos | deportarlas | (echar | expulsar | encerrar | fusilar | matar | deportar) a (todos | todas)? <group>)"),
    ("hate", 0.75, "que se pudran"),
    ("hate", 0.85, "(send | ship | drive | kick) (all | back)* (<group> | them all) (back to | back where | home to | into the sea | out of (our | the | this) (country | city | town))"),
    ("hate", 0.85, "((round up | drive out | wipe out | get rid of | exterminate | deport all | deport every) <group> | <group> a la (cocina | calle | carcel) | fuera (los | las | todos los)* GROUP | <group> (sind an allem schuld | tienen la culpa) | (odeio | odio) (os | as | todos os)* GROUP | (deviam | deveriam) morrer todos)"),
    ("hate", 0.85, "(never | do not | don t | dont) (lend | sell | rent | talk | listen | speak | give | trust | hire | employ) _{0,3} to? <group> _{0,8} (are | re) (all)? _? VERMIN"),
    ("hate", 0.8, "(never | do not | don t | dont) (trust | hire | rent to | employ) (a | an)? (<group> | jew | muslim | gypsy | black | arab | mexican | immigrant | foreigner | woman)"),
    ("hate", 0.85, "(keep | get | throw | kick | drive | chase | send) (all)? <group> (off | out | out of | away from | back) _{0,6} (they are | they re | inferior | thieves | stupid | born | always will be | country | belong | home | streets)"),
    ("hate", 0.85, "(their kind (only | just | always | will)* (steal | steals | lie | lies | ruin | ruins | cheat | cheats | destroy | destroys | spread | spreads | bring | brings | breed | breeds | kill | kills | belong | belongs) | su (gente | raza) solo (roba | miente) | (go back | piss off back) to (your | their) own? (country | continent | hole | jungle | desert))"),
    ("hate", 0.9, "((once | when | after) we (deal | clean | are done | finish | get rid | have dealt | wipe | purge) _{0,10} there (will | ll) be none (left | of them) | there (will | ll) be none left in)"),
    ("hate", 0.75, "((is | was | are | were | s) all? the fault of <group> | blame (the | those | these)? (jews | muslims | immigrants | gypsies | blacks | refugees) | es? la? culpa es? de <group> | schuld (sind | daran) (die)? GROUP)"),
    ("hate", 0.85, "(con | a) <group> no se (negocia | habla | discute | pacta | escucha | contrata | comparte | come | trabaja)"),
    ("hate", 0.9, "no (hay que | se debe | conviene) (contratar | ayudar | escuchar | dejar entrar | creer | prestar | prestarles) a <group> _{0,6} (VERMIN | roban | mienten | ladrones | inferiores)"),
    ("hate", 0.8, "(<them> _{0,2} live off (our | your | the) (taxes | money | work | state) | live off our taxes | crawl in like | (i | we) hate (all | the | those | these | every)* (GROUP | DEMONYM | (GROUPADJ | DEMONYM) people) | odio a (los | las | todos los) GROUP | ich hasse (alle | die)? GROUP | death to (all | the)? (GROUP | DEMONYM) | muerte a (los | las | todos los) GROUP | (auslander | juden | zigeuner | schwarze) raus | (kill | gas | hang | shoot | exterminate | lynch) (all | every | the)+ (GROUP | DEMONYM | GROUPADJ people))"),
    ("hate", 0.75, "(<group> are | every ONE is) (all | just | only | nothing but | a | an | naturally | FOUL | sick)* (thieves | thief | criminals | criminal | rapists | rapist | terrorists | terrorist | liars | liar | lazy | stupid | filthy | dirty | disgusting | idiots | whores | perverts | pervert | scammers | scammer | killers | cheats | dumber | INSULT | VERMIN)"),
    ("hate", 0.75, "(los | las | os | as | die) (GROUP | DEMONYM) (son | sao | sind) (todos | todas | alle | unos | unas)? (INSULT | ladrones | criminales | vagos | sucios | ladroes | criminosos | preguicosos | kriminelle | faul | dreckig | verbrecher)"),
    # sexually explicit language
    ("sexual", 0.9, "PORN"),
    ("sexual", 0.9, "TOUCH (my | your | his | her | their | the | big | hard | wet | tu | su | mi | its | sus | seu | seus | meu | ihre | seinen | le | la | el | los | las | o | a)* _? BODY"),
    ("sexual", 0.9, "((my | his | your | her) BODY (is | was | got | felt) (so | all)? (hard | wet | throbbing | dripping | stiff) | (his | my | your) (cock | dick | verga | polla | schwanz) (in | into | inside) (her | my | your | his) | (he | she | they | i) fucked (her | him | them) (on | in | at | against | over | and | $ | from | until))"),
    ("sexual", 0.9, "(suck | sucks | sucking) (cock | cocks | dick | dicks | tits)"),
    ("sexual", 0.9, "(want | wants | wanna | going | love | ready | need | begging | begs | begged) to? (fuck | be fucked | (bang | screw | shag) (you | her | him | me | them))"),
    ("sexual", 0.9, "(fuck | fucked | fucks | fucking) (me | her | him | you all night | them | you) (hard | all night | tonight | again | senseless | raw | harder | from behind | slowly)"),
    ("sexual", 0.9, "(follarte | follarme | follar | follamos | cogerte | garchar | foder voce | ficken | gefickt | fickte | fickten | transar contigo)"),
    ("sexual", 0.9, "((he | she | they | i) (came | finished | cum | cums | spilled | exploded) _? (all over | inside | in | on | over) (her | him | me | my | his | them) | came all over | cum (on | in) (my | her | his | your) _)"),
    ("sexual", 0.9, "THRUST _? deep? (into | inside | in | en | o pau | o pau em)* (her | him | me | nela | nele | ihr | ihn)"),
    ("sexual", 0.9, "(between (her | his | my | your) (legs | thighs) | (rode | took | mounted | straddled) (her | him | me) (hard | roughly | from behind | slowly | all night) | (begged | begging) (him | her) (not to stop | for more | to be taken) | she begged (for more | him not to stop | to be taken))"),
    ("sexual", 0.85, "(NUDE _{0,8} PLEASURE | PLEASURE _{0,8} NUDE | PLEASURE _{0,10} TOUCH _{0,3} BODY | TOUCH _{0,12} PLEASURE | PLEASURE de placer | PLEASURE de prazer | PLEASURE vor lust)"),
    ("sexual", 0.85, "((arranco | quito | saco) la ropa | le (bajo | quito | arranco) (las | los) (bragas | pantalones | calzones) | beso por todo el cuerpo | puso (desnudo | desnuda) sobre | tore (off | her) (panties | bra | clothes) | (pulled | slid | took) (down | off) (her | his | my) (panties | bra | underwear) | unzipped his (pants | trousers) and | arrancou a (roupa | calcinha) | (zog | riss) ihr (das hoschen | den bh | die kleider) (aus | herunter))"),
    ("sexual", 0.85, "((nude | naked | nudes | xxx | uncensored | horny | sexy | explicit | desnuda | desnudas) MEDIA | LEWD MEDIA ($ | of (me | her | girls | women | my) | for you | here | inside | now | tonight | waiting | dm | i | no | and | in bio | entra | free | gratis | on cam) | MEDIA LEWD | (watch | see | meet | hot | chicas | videos de | with) LEWD (girls | women | teens | wives | sluts | boys | chicas | mujeres | babes) | sexo en vivo | live sex | sex (chat | cam | cams | video | videos | tape | live | toys | slave) | sin censura | no (panties | clothes | limits) | sexo (ao vivo | gratis | anal | oral) | (anal | oral) sex | gratis sex)"),
    ("sexual", 0.85, "((do | does | doing) (anything | everything) in bed | horny _{0,2} (singles | girls | women | wives | boys | men | housewives | students | couples | milfs | moms) | dressed whores | whores (waiting | near | for) | tonight on cam | (strip | strips | stripping) (and suck | for you | naked | live) | (espera | esperan | espero) (desnuda | desnudas | desnudo | desnudos) | (girls | women | sluts) (near you | in your area) | send (me)? nudes | (desnuda | desnudas | desnudo) sobre (el | la) (cama | escritorio | mesa | sofa))"),
]

#: Speaking of oneself, and reporting what others said or did; both lower what they govern.
ONESELF = "(i am | i m | im | i was | i feel like | call me | calls me | called me | myself | soy | fui | me siento | eu sou | ich bin | my own | i feel)"
REPORTING = """(prosecutors | said that | says that | say that | claimed that | claims that | shouted that | wrote that | propaganda | novel | historian | historians | museum | memoir | documentary | report on | report of | reports of | removed a post | complaint | complaints | ombudsman | moderator | moderators | harassment | hate speech | abusive language | regulator | was accused | were accused | is accused | stands accused
    | denied having | study of | survey of | court heard | tribunal heard | jury heard | fined for | banned for | sacked for | suspended for | sentenced | investigate | investigates | investigated | investigating | investigation | apologised | apologized | apologise | quoted as
    | according to | allegedly | convicted | slur | slurs | denuncia | informe sobre | moderador | acusado | acusada | acusados | acusadas | discurso de odio | beschwerde | reportagem | denunciou | verurteilt | angeklagt | condenado | condenada | training module | content policy | policy forbids | guidelines forbid | example of abuse)"""  # fmt: skip
