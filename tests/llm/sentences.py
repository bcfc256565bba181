"""Sentences of our own, none from the tables, that the lexicon is measured on.  They were written after it; nothing was tuned to them."""

ABUSIVE = {
    "en": """You are nothing but a worthless parasite.
Shut your mouth, you stupid cow.
I swear I will strangle you if you push to main again.
Go hang yourself, loser.
All those immigrants are vermin and ought to be deported.
Women like you belong in the kitchen.
Show me your boobs before the meeting starts.
He called her a filthy whore in front of everybody.
What a pathetic little man you are, a complete waste of oxygen.
Nobody likes you and nobody ever will, freak.
I know where your kids go to school, I will hurt them.
You fucking idiot broke it again.
hope you get cancer and die
those people are animals, they breed like rats
suck my dick
The reviewer is a m0ron and an a$$hole.
somebody should kick your teeth in
you absolute imbecille
She is a dumb slut who slept her way up.
You retarded monkey, read the docs.""",
    "de": """Halt endlich deine dumme Fresse.
Du bist so ein erbärmlicher Idiot.
Ich bringe dich um, wenn du das nochmal machst.
Geh sterben, du nutzloses Stück Dreck.
Alle Ausländer sind Ungeziefer.
Frauen gehören in die Küche.
Verpiss dich, du Hurensohn.
Zeig mir deine Titten.
Ich schlage dir die Zähne ein.
So ein Arschloch wie dich braucht keiner.
Du Vollidiot hast alles gelöscht.
Die gehören alle vergast.
Leck mich am Arsch, Wichser.
Häng dich auf, dich vermisst keiner.
Was für eine dreckige Schlampe.
Du dummes Schwein.""",
    "fr": """Ferme ta sale gueule.
Tu es vraiment un gros connard.
Je vais te casser les dents.
Va crever, espèce de merde.
Ces étrangers sont de la vermine.
Les femmes, à la cuisine.
Nique ta mère, enculé.
Montre tes seins, salope.
Je vais venir chez toi et te tuer.
Pauvre con, tu ne sers à rien.
Quel abruti a écrit ça, un débile ?
Suce ma bite.
Sale pute, dégage d'ici.
Suicide-toi, personne ne te regrettera.
Tu n'es qu'un sac à merde.
Rentrez chez vous, sale race.""",
    "es": """Cierra la boca, imbécil.
Eres un pedazo de mierda.
Te voy a matar, hijo de puta.
Muérete ya, nadie te quiere.
Los inmigrantes son ratas, hay que echarlos.
Vete a la mierda, gilipollas.
Enséñame las tetas, guapa.
Te voy a romper las piernas.
Qué asco de persona, eres una basura.
Chúpame la polla.
Eres un inútil y un tarado.
Vuelve a tu país, sudaca.
Pégate un tiro, pendejo.
Ese cabrón otra vez.
Tu madre es una puta.
Cállate la puta boca.""",
    "zh": """你这个傻逼，滚开
去死吧，没人会想你
我要杀了你全家
他们都是畜生，应该全部赶走
脱光给我看
你妈的，又写错了，蠢货
真是个废物，没用的东西
打断你的狗腿
操你妈
女人就该在厨房待着
你怎么不去死
这个贱人又来了
滚回你老家去
小婊子，张开腿
白痴写的代码
死胖子，丑八怪""",
}
HARMLESS = {
    "en": """The parasite removal job killed the parent process and its children.
I feel like an idiot for missing that semicolon.
The abusive comment was removed by a moderator yesterday.
The word moron is on the blocklist.
Breast cancer screening starts at fifty.
We should drop dead code before the release.
Please shut down the master before you kill the slave node.
The rat liver samples were frozen at minus eighty degrees.
This stupid build fails every Monday.
I disagree with your design, it is far too complicated.
He will find you in the lobby and help you with the badge.
A race condition in the worker makes the cache dirty.
The dog bit the postman, so we put up a fence.
The sex column may be null in the patient table.
Garbage collection pauses hurt the tail latency.
Your patch breaks the neck of the hourglass model in the docs.
The killer feature is the one that your kids will love.
In the novel the pig becomes a dictator.
Don't beat yourself up over it.
We hang the pictures in the hall and burn the old boxes.""",
    "de": """Der Prozess wird nach dem Timeout beendet.
Ich Idiot habe den Schlüssel vergessen.
Der Filter erkennt das Wort Arschloch.
Das dumme Skript läuft nicht.
Der Hund schläft in der Küche.
Wir schlagen vor, den Index zu löschen.
Die Schweine im Stall bekommen neues Futter.
Kannst du mir bitte helfen, die Tabelle zu finden?
Ratten wurden im Versuch mit Futter versorgt.
Die Abstimmung gehört in die Küche der Ideen.
Er bringt dich um neun Uhr zum Bahnhof.
Das Ungeziefer im Getreidelager wurde bekämpft.
Der Vorschlag ist schlecht begründet.
Die Sendung wurde abgebrochen.
Ein elender Tag, alles ging schief.
Der Ausschuss lehnt den Antrag ab.""",
    "fr": """Le train est en retard de dix minutes.
Je suis un idiot, j'ai oublié le mot de passe.
Le rapport sur les insultes est prêt.
Ce script est vraiment nul.
La chatte de la voisine a eu des petits.
Ferme la porte et casse les œufs.
Le porc est cuit à point.
La vermine a détruit la récolte.
Ta réponse est incomplète, ajoute un exemple.
Les moteurs à poil dur sont rares.
Il faut tuer le processus avant minuit.
Le canard nage sur l'étang.
Je vais te montrer le tableau.
Le débit est trop faible.
Elle retourne dans son pays en mai.
La gueule du loup est une expression.""",
    "es": """El proceso se cierra a medianoche.
Soy un tonto, olvidé la clave.
La palabra está en la lista de términos.
Este script no sirve para nada.
La zorra cruzó el río.
Cierra la ventana, por favor.
La rata de laboratorio recibió la dosis.
Voy a romper la tabla en dos partes.
Tu propuesta necesita más datos.
Hay que eliminarlos de la cola.
La basura se recoge el martes.
Los números subnormales pierden precisión.
Te voy a enviar el informe.
El cerdo se cría en el norte.
No estoy de acuerdo contigo.
Vuelve a tu asiento.""",
    "zh": """请把进程杀掉再重启
我自己真是个笨蛋
屏蔽词里有傻逼这个词
这个测试又失败了，真烦
机器学习模型需要更多数据
滚动条不能滚到底部
垃圾回收暂停时间太长
他去世了，大家都很想他
请关闭窗口并保存
老鼠实验的数据已经归档
脱敏后的数据可以公开
这个方案不够好，请补充理由
废物利用是环保的好办法
做爱护环境的人
天生的领导者
操作系统需要升级""",
}
