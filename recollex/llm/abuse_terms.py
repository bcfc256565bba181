"""Fixed values of the abuse operator: terms, patterns and cues by language.

General vocabulary of the five languages; turns of phrase that one corpus uses are learned
from its reviews (`abuse.learned`).  Terms marked strong insult, degrade or are explicit by
themselves; weak ones only when they are aimed at a person.  Patterns are built from classes
of words, `{class}` or `(one/other)`; `_` stands for up to three words.
"""

#: Strong terms, by category.  Fixed values.
STRONG = {
    "insult": """
        arsehole assclown asshat asshole bastard bellend bitch bootlicker brainless cocksucker cretin cuck cunt
        dickhead dickwad dimwit dipshit douchebag dumbass dumbfuck fatso fuckface fuckwit halfwit idiot imbecile jackass knobhead
        lowlife moron motherfucker nitwit numbskull nutjob schmuck scumbag shitbag shithead shitstain simpleton
        sonofabitch tosser twat wanker
        abschaum arschgeige arschloch blödmann depp drecksau drecksack drecksvieh dreckskerl dummkopf fettsack flachwichser
        hackfresse hurensohn idioten missgeburt miststück mistkerl pissnelke saftsack scheißkerl schwachkopf schweinehund
        spasti trottel vollidiot vollpfosten wichser
        abruti bouffon branleur connard connasse conasse couillon crétin débile enculé enfoiré fdp raclure salaud salopard
        tocard trouduc
        bastardo cabrón cabronazo capullo cretino desgraciado gilipollas hijoputa huevón idiota imbécil malnacido malparido maricón
        mamón mongólico pendejo pringado tarado
    """,
    "hate": """
        subhuman subhumans untermensch untermenschen ungeziefer untermenschlich infrahumano infrahumanos sous-homme
        faggot nigger kike tranny spic wetback towelhead raghead
        schwuchtel kanake bougnoule bicot youpin sudaca
    """,
    "sexual": """
        blowjob blowjobs boobs creampie cumshot deepthroat dildo fellatio gangbang handjob horny jizz masturbating milf nudes orgasm
        pussy slut sluts tits titties whore whores
        fotze hure muschi nutte schlampe titten bumsen wichsen
        chatte nichons pétasse pute salope branlette
        chocho coño cachonda cachondo follarte mamada polla puta ramera tetas verga zorra
    """,
}

#: Terms that need an aim.  Fixed values.
WEAK = """
    animal animals clown coward cow creep degenerate disgusting donkey dumb failure filth filthy freak garbage goddamn hag hideous incompetent inferior leech liar loser maggot
    miserable monkey moronic parasite pathetic pig pigs prick rat rats retard retarded scum shit shitty shameless skank snake spineless stupid swine trash ugly useless vermin vile weirdo witless worm worthless
    cock cocks dick arse ass bonehead dunce fuck fucking chink
    blöd blöde blöder blödes doof dreckig dreckige dummer dumme dummes ekelhaft esel fresse geile kotzbrocken nutzlos nutzlose penner sau scheiß scheiße schwein widerlich
    alimañas crasseux dégueulasse minable moche ordure porc puant vermine
    asqueroso asquerosa cerdo cerda estúpido estúpida feo inútil mierda patético rata subnormal tonto
"""

#: Words that may stand in one place of a pattern.  Fixed values.
CLASSES = {
    "kill": "kill murder stab strangle choke butcher slaughter behead gut lynch",
    "hurt": "beat punch hurt cut smash bash whip hang burn drown hit slap kick rape",
    "hurting": "beaten punched smashed bashed whipped hanged hung burned burnt drowned slapped kicked raped shot killed murdered stabbed strangled choked gassed lynched castrated sterilized deported exterminated aborted",
    "break": "break smash bash crush snap slit cut punch kick slap rip bust cave",
    "body": "neck legs leg bones bone face skull head throat jaw teeth fingers arms arm knees kneecaps spine nose guts wrists",
    "will": "will would gonna shall should could must",
    "suffer": "suffer bleed pay regret cry beg scream die",
    "die": "die rot suffer choke bleed burn drown perish",
    "kin": "family kids children mother wife house daughter sister",
    "live": "live work sleep park hide",
    "waste": "waste sack pile piece bag lump",
    "stuff": "shit trash garbage crap filth scum skin space oxygen air flesh meat dirt",
    "vile": "vermin rats rat animals apes monkeys parasites cockroaches subhuman subhumans filth scum savages thieves criminals plague disease cancer garbage trash pigs dogs beasts",
    "they": "they those these them people foreigners immigrants migrants refugees women men gays jews muslims blacks",
    "curse": "stupid dumb ugly fat filthy dirty worthless useless pathetic disgusting miserable brainless fucking goddamn bloody damn lazy rotten slimy hideous lousy",
    "curse_noun": "cow pig rat dog worm clown loser freak creep whale snake donkey monkey animal parasite leech maggot trash garbage scum swine hag liar coward fool failure weirdo ass shit fuck piece",
    "shut": "mouth face trap hole cakehole gob",
    "sex": "fuck bang suck lick shag screw ride",
    "parts": "tits boobs ass cock dick pussy cunt balls nipples",
    "wet": "hard wet tight big naked juicy dripping throbbing nice hot sweet",
    "töten": "töte töten umbringen bring bringe erschieße erschießen erwürge ersteche abstechen schlachte vergase",
    "körper": "fresse schädel zähne genick knochen beine beinen nase hals schnauze kopf",
    "schimpf": "dumme dummer dummes blöde blöder blödes dreckige dreckiger dreckiges hirnlose hirnloser hirnloses widerliche widerlicher widerliches verdammte verdammter verdammtes elende elender elendes fette fetter fettes miese mieser mieses dämliche dämlicher dämliches",
    "tuer": "tuer égorger étrangler crever buter massacrer défoncer frapper casser péter exploser éclater violer planter cogner",
    "corps": "gueule figure tête jambes dents nez os bras mâchoire",
    "insulte": "merde con porc chien truie ordure pute salaud minable débile pourri crasseux imbécile idiot",
    "matar": "matar degollar estrangular reventar partir romper pegar apuñalar quemar rajar destrozar violar",
    "cuerpo": "cara piernas cabeza boca dientes cuello huesos brazos hocico",
    "insulto": "mierda basura asco cerdo perro rata inútil imbécil estúpido animal gusano",
}

#: Patterns that threaten, degrade or are explicit whatever their single words.  Fixed values.
PATTERNS = {
    "threat": """
        (i/we/ill/someone/somebody/they) _ {kill} you|(i/we/someone/somebody) _ {will} _ {hurt} you|(i/we/ill) _ (break/smash/slit/cut/crush/snap/bash/punch) your _ {body}|{break} your {body}|{break} your _ {body} in|{kill} your {kin}|{kill} you and|(i/we) _ (kill/find/rape/hurt) your {kin}
        {kill} (yourself/yourselves)|(hang/drown/hurt/off) (yourself/yourselves)|kys|end your (own/miserable/pathetic/sorry) life|drink bleach|eat a bullet|bullet (in/into/through) (you/your)|jump off a (bridge/cliff/roof/building)|jump in front of a (train/bus/truck)
        go die|drop dead|die in a fire|(hope/wish) you _ {die}|(hope/wish) (he/she/they) _ (die/rot/suffer/choke)|you deserve to {die}|deserve to be {hurting}|deserve to (die/suffer/rot)|you (should/must/will/ought) _ be {hurting}|you should (die/rot)|better off dead|glad when you die
        (nobody/no) (would/will) miss you|no one (would/will) miss you|better without you in it|watch your back|(know/knows) where you {live}|find you and {kill}|find you and {hurt}|find you and make you|find your {kin}|make you {suffer}|you _ going to (bleed/suffer/regret)|you will (bleed/suffer/regret)|you (are/re) dead meat
        coming for you|one eye open|your days are numbered|dance on your grave|at your funeral|beat the (shit/crap/hell) out of you|beat you (up/bloody/senseless)|beat you to (death/pulp)|teach you a lesson you|burn your house|wish you were dead|wish you were never born|stop breathing
        bring dich _ um|bringe dich _ um|(ich/wir) _ {töten} dich|(ich/wir) {töten} dich|schlag dir _ {körper}|schlage dir _ {körper}|hau dir _ {körper}|haue dir _ {körper}|brech dir _ {körper}|breche dir _ {körper}|schlag dich tot|stirb endlich|geh sterben|verreck|verrecke|(vermisst/vermissen) (dich/dir) keiner|dich vermisst keiner|weiß wo du wohnst|häng dich auf|spring von _ brücke|du wirst bluten|mach dich fertig|stech dich ab
        va (crever/mourir)|crève|(vais/va) (te/vous/t) _ {tuer}|te {tuer} la {corps}|te {tuer}|{tuer} la (gueule/figure/tête)|sais où tu (habites/vis)|(personne/nul) ne te (regrettera/regretterait)|suicide toi|pends toi|tu vas (crever/mourir/saigner/regretter)|je t égorge
        mátate|muérete|(voy/vamos) a {matar} (te/la)|te (voy/vamos) a {matar}|{matar} (la/las/los/el) {cuerpo}|voy a matarte|ojalá te mueras|nadie te (va/extrañará/echará) _ (extrañar/menos)|sé dónde vives|te voy a encontrar|te vas a arrepentir|córtate las venas|pégate un tiro
    """,
    "insult": """
        fuck (off/you/yourself)|go fuck|go to hell|piss off|shut your _ {shut}|shut the fuck up|(kiss/lick) my ass|eat shit|screw you|get lost {curse_noun}|{waste} of _ {stuff} (like/you)|you {waste} of {stuff}|(a/such/complete/absolute/utter) waste of (skin/oxygen/flesh/space/air)|(sack/pile) of shit|you piece of {stuff}|is a piece of (shit/scum)|son of a bitch|sons of bitches
        you {curse} _ {curse_noun}|you {curse_noun} {curse}|you {curse} {curse}|listen {curse_noun}|(as/so) (dumb/stupid/ugly/worthless/useless) as (you/your)|(uglier/dumber/stupider) than|your (ugly/stupid/fat/disgusting/dumb/filthy) {body}|your (ugly/stupid/fat/disgusting/filthy) mouth
        should have been (aborted/drowned/swallowed)|(your/his/her) (parents/mother) should have|(nobody/no/everybody/everyone) (likes/wants/loves/hates/asked) (you/your)|two brain cells|half a brain|(too/so) (dumb/stupid) to|never been born|put down like _ (dog/dogs)|breathing my air|(stop/quit) wasting _ (oxygen/air)|crawl back (to/under/into)|crawled out of|a face only|bunch of _ (idiots/morons/retards/bitches/losers/clowns)|you people are (idiots/stupid/disgusting)
        du {schimpf}|halt _ (fresse/maul/schnauze)|halts maul|halt die klappe|verpiss dich|fick dich|leck mich|stück (scheiße/dreck)|geh mir aus den augen|zu (dumm/blöd) (zum/um)|(so/dumm/blöd) dumm wie|du bist _ (abschaum/dreck/müll/scheiße/wertlos/nutzlos)
        ferme ta (gueule/bouche)|ta gueule|va te faire|nique ta mère|fils de (pute/chien)|casse toi|espèce de|(sac/tas) (à/de) merde|tête de (con/noeud)|(gros/grosse/sale/pauvre/petit/petite) {insulte}|pauvre type|tu n es qu|t es qu une merde|tu pues
        vete a la (mierda/chingada)|vete al (infierno/carajo)|(cállate/cierra) la (boca/puta)|cierra el pico|hijo de (puta/perra)|hija de (puta/perra)|que te (jodan/den)|chúpame|me cago en|pedazo de {insulto}|eres (un/una) _ {insulto}|das asco
    """,
    "hate": """
        {they} _ are _ (nothing/just/only/all) _ {vile}|{they} _ are {vile}|(all/most) of them are {vile}|are {vile} and (should/must/deserve)|breed like (rats/rabbits/flies/cockroaches)|(inferior/subhuman) (race/people/tribe/breed/blood)|(should/must) be (gassed/exterminated/deported/lynched/castrated/sterilized)|(should/must) be (wiped/driven/thrown) (out/off)|wipe (them/you) (out/off)
        (your/that/their) (kind/sort/race) _ (should/belongs/belong/must)|(deport/gas/exterminate/lynch/hang/shoot) (every/all/the) {they}|gas the|deport (every/all/them)|send them back|go back to your (own/country)|go back where you came|(belong/belongs) in (the/a) (kitchen/zoo/cage/oven/gutter)|not be allowed to (breed/vote/reproduce)|(women/cripples/retards/gays) should (not/never/stay/be)|never trust a (jew/muslim/black/woman/foreigner)|thieves by (blood/nature/birth)
        (ausländer/juden/flüchtlinge/moslems) raus|(gehören/gehört) (vergast/abgeschoben/ausgerottet/erschossen)|sind (ungeziefer/abschaum/parasiten/ratten/untermenschen/tiere)|(gehören/gehört) in die küche|geht zurück in euer|(diebe/verbrecher) von geburt
        sont (de/des/la) (la/vermine/parasites/rats/animaux) _|sale race|sales (arabes/juifs/noirs/étrangers)|rentrez chez vous|retourne dans ton pays|race inférieure|à la cuisine les femmes|(voleurs/criminels) de naissance
        son (alimañas/basura/ratas/parásitos/animales/escoria)|hay que (echarlos/eliminarlos/matarlos/exterminarlos)|que se larguen|raza inferior|vuelve a tu país|vuélvanse a su país|fuera (todos/los) (los/extranjeros/moros/negros)|(ladrones/criminales) de nacimiento
    """,
    "sexual": """
        spread your (legs/cheeks)|(suck/lick/ride/stroke/swallow) (my/his/your/her) _ {parts}|(suck/lick) my|(my/his/your/her) _ (cock/dick/pussy/tits/boobs/cunt)|{wet} _ (cock/cocks/dick/pussy/tits/boobs/cunt)|(want/going/gonna/love) to (fuck/bang/shag/screw/lick) (you/her/him)|(want/wanna) _ (naked/undress) (you/me/her)|{sex} (you/her/me) (on/in/from/until/till/all/hard)|rip (your/her) clothes off|(take/get) your clothes off|take off your clothes|(bend/get) over (baby/and/bitch)|sit on my (face/lap/cock)|send me _ (nudes/nude)|(naked/nude) (pictures/photos/pics) of you|show me your _ {parts}|show your tits|jerk (off/me)|jerking off|anal sex|oral sex|sex with you|(touch/touching) (yourself/myself) (for/while/and)|(so/you) (horny/wet) for|make you (moan/scream my)|get you pregnant|moaned _ (while/as) _
        zieh dich aus|zeig (mir/deine) _ titten|blas (mir/ihm)|lutsch|fick mich|fick dich durch|beine breit|nackt vor mir|bläst mir
        montre _ (tes/seins) (seins/fesses)|écarte les (jambes/cuisses)|suce (moi/ma)|baise moi|te baiser|déshabille toi|mets toi nue|à poil
        enséñame (las/tus) tetas|muéstrame (las/tus) tetas|enseña las tetas|abre las piernas|chúpamela|quiero follarte|desnúdate|te quiero desnuda|ponte de rodillas
    """,
}

#: Turns that begin like a pattern and are none.  Fixed values.
HARMLESS = "shoot you an|shoot you a|shoot yourself in the foot|beat you to it|beat you to the|cut you off|cut you some|hit you up|break your build|kill you with kindness|find you and help|find you and make you an|go back to your seat|hang yourself up|punch your card|my dick jokes|kick your habit"

#: Chinese patterns as regular expressions, matched in the text itself.  Fixed values.
CHINESE = {
    "insult": "傻[逼屄比叉] 煞笔 蠢[货猪驴蛋] [混坏王八]蛋 废物 贱[人货种] 白痴 脑[残瘫] 智障 弱智 畜[生牲] 狗(东西|杂种|娘养|屎|日的) 杂种 人渣 败类 臭(嘴|婊子|不要脸) [操草肏艹日]你(妈|娘|大爷|全家)? 你妈(的|逼) 他妈的你 去你(妈|的吧) 滚(开|蛋|出去|远点) 恶心人 不要脸 无耻(的|之徒) 你这个(该死|垃圾|没用|愚蠢|恶心) 没用的(东西|垃圾|废) 死(胖子|肥猪|变态|三八) 丑八怪 婊子养",
    "threat": "去死(吧|啊)? 你(怎么不|快|赶紧)去?死 (杀|宰|弄死|打死|砍死|掐死|捅死|揍扁|揍死|整死)了?你(们|全家)? 打断你的?(腿|手|狗腿) (打烂|撕烂|撕碎)你 没人会?(想|在乎)你 你等着瞧 要你的?命 (找到|知道)你(家|住|的家) 自杀吧 跳楼(吧|去) 让你(后悔|好看|生不如死)",
    "hate": "都是(害虫|畜生|贼|蟑螂|垃圾|寄生虫|劣等) (低等|劣等)(民族|种族|人)? (应该|必须)(全部|统统|都)?(赶走|灭绝|杀光|消灭|驱逐) 滚回(去|你|老家|自己) 天生的?(贼|罪犯|奴才) 女人就该 残废(就|就该|都该)",
    "sexual": "脱光 骚(货|逼|女人) 婊子 荡妇 奶子 操我 (鸡|几)巴 阴(茎|道) 约炮 裸照 (跟|和|想)你?做爱 口交 上床吧 (给我|让我)看(你的)?(胸|奶) 露胸 张开(双)?腿 舔我",
}
#: Words before a Chinese match that take it back: the speaker, refusals and lists.  Fixed values.
CHINESE_BACK = "我自己 自己 词表 词库 屏蔽词 敏感词"

#: Words of address; a weak term near one is aimed at a person.  Fixed values.
ADDRESS = "you your yours yourself youre du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous tú ti usted ustedes vosotros eres he she they them those these"
#: Words of address that count only right before a term, or when another term follows; those that count right before one.  Fixed values.
LOOSE = frozenset("your dein deine ton ta tes these those they he she them ihr te tu".split())
CLOSE = frozenset("te tu he she".split())
#: Words that a weak term may have between itself and the address.  Fixed values.
LINKS = "a an the are is re bunch of such absolute complete total little big old whole lot as so really fucking goddamn bloody damn utter ein eine bist so un une es una qué que eres est"
#: The speaker about themselves: a term right after one of these is no abuse.  Fixed values.
SELF = "m im myself ich bin ai étais je soy fui estaba"
#: The speaker's own phrases, within the words before a term.  Fixed values.
SELF_PHRASES = "my own|i am such|i was such|i am a|i am an|what an|ich bin|ich war|j'ai été|je suis|je fus|soy un|soy una|fui al|qué tonto fui|am i"
#: Words of talk about terms rather than use of them.  Fixed values.
MENTION = "blocklist wordlist lexicon filter filtered moderation moderator classifier detector keyword keywords profanity slur slurs glossary-entry term terms label labelled category policy"
#: Marks of a repeated message.  Fixed values.
QUOTING = "quoting quoted wrote said reported cites zitat citation cita"

#: Letters of other scripts, digits and signs that stand in for Latin letters.  Fixed values.
LOOKALIKES = "аaеeоoрpсcхxуyкkмmтtнhвbіiјjѕsԁdɡgαaεeοoρpτtυuκkνvιi"
STAND_INS = "0o1i3e4a5s7t$s@a!i"
