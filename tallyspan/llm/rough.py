"""Sentences written for this package that teach problem 9 what rough words don't make a case, and what cases look like.

The labelled comments hold few plain sentences with offending words, so that such words alone would decide. Fixed values.
"""

from __future__ import annotations

#: Swearing at nobody, praise in rough words, talk of oneself, of things, of fights, of misconduct and of groups; words of two meanings.
PLAIN = """\
Oh fuck, I left my phone in the cab.
Shit, that was close.
Well, shit, there goes my parlay.
What the fuck was that scorecard?
Fuck me, what a comeback!
Fuck yeah, main event time!
Hell yes, what a round!
Oh shit, he got up again!
Bloody hell, that was quick.
That was one hell of a fight.
What a shit show of a broadcast.
No shit, the favourite won again.
Son of a bitch, I missed the start!
This app is trash since the update.
The new scoring system is garbage, in my view.
The parking at that arena is shit.
Traffic on the bridge was a bitch tonight.
Cutting weight in winter is a bitch, she said.
It was a bastard of a climb to the cheap seats.
Life is a bitch sometimes, so keep training.
My luck is shit this week.
A stupid rule, if there ever was one.
The dumb camera angle hid the best part.
The ugly truth is that both were tired.
It was an ugly win, but a win.
The first half was a waste of time and money.
Useless stat of the day: both were born in May.
The gloves were pathetic quality and fell apart.
The pizza at the venue was disgusting and cost a fortune.
He is an absolute animal in there, what a talent.
She is a savage, the best in the division.
You absolute beast, what a performance!
You mad bastard, you did it, congratulations!
Sick finish, nasty elbow, beautiful timing.
Nasty, just nasty, in a good way.
A nasty hook and a lovely counter.
Stupid good hands on that kid.
It is stupid how good she is.
Dirty boxing at its finest, lovely work.
The dirtiest setup of the year, pure class.
Crazy sexy footwork, I love it.
What a monster, what a machine!
Insane heart, respect to both.
I felt like a fool after that pick.
I am such a moron, I sold my ticket.
My dumb brain took the under again.
I looked stupid with that prediction.
I was stupid enough to leave early.
We were useless at picking winners this month.
Call me a clown, but I had the challenger ahead.
I am a coward when it comes to big bets.
Silly me, I was a loser again at the tables.
He said he felt worthless after the loss and took a year off.
She admitted that she had been a fool to skip camp.
He called his own defence garbage.
The league fined him for calling an official a bitch.
He was suspended for a slur against gay fans.
Police are looking into threats to kill the judge.
Two users were banned for sexual comments about a reporter.
A fan was thrown out for shouting insults at women.
The hearing was about claims of harassment and rape.
She told the panel that strangers had sent her nude pictures.
The report lists attacks on immigrants and refugees near the stadium.
Please do not post insults, threats or porn here.
The moderators deleted an abusive thread last night.
Sex testing rules were updated by the federation.
The form asks for name, sex and date of birth.
Both sexes train together on Fridays.
The foul could be seen with the naked eye.
The stage was naked wood and steel.
Oral statements were heard by the panel.
A police escort led the team to the hotel.
Penetration of the streaming market grew by nine percent.
The hardcore fans stayed until the end.
The uncensored press conference is on the club page.
Adult tickets cost twenty, children go free.
The swimmers undress in the room on the left.
The topless roof of the arena lets the rain in.
The dogs barked outside the arena all night.
A rat ran through the locker room.
The pigs on his farm won a prize.
Roaches closed the kitchen for a day.
Parasites in the water made the team ill.
Thieves took the belts from his car.
The garbage truck blocked the entrance.
Put your trash in the bin, please.
The clown at the halftime show juggled gloves.
The losers of the first round meet on Monday.
The loser leaves town, says the poster.
Women earned the same purse as men tonight.
The women and girls of the club won gold.
The gay champion was cheered by the whole crowd.
Muslim fighters fasted during the camp.
Immigrants from three countries train at this gym.
Refugees run a free class on Mondays.
Jewish and Arab boxers shared a stage in spring.
Black trunks, white gloves, red corner.
He killed it tonight, what a show.
She strangled him with the collar choke.
He tried to break the arm from the guard.
He was beaten to the punch all night.
That bomb of a right hand put him to sleep.
She smashed the pads for an hour.
He hunts for the takedown from the first second.
His skull was cracked and the nose was broken.
He was dead tired on the stool.
He bled from the throat guard to the knee.
The punch to the throat was an accident.
The referee told them to break.
A clean shot landed on the break.
They went to war and both drowned in the pace.
He has a gun of a left arm.
She burned out after four hard camps.
Trash talk is part of the game, he said.
The old nickname Mad Dog stuck.
Kill the lights, the walkout starts.
The crowd was on fire, the hall was burning hot.
¡Qué puta locura de final!
Mierda, se me cayó la señal.
Vaya mierda de conexión que tengo.
Qué tonto fui al gastar tanto.
Soy un burro para los pronósticos.
Es un animal en la jaula, enorme.
Lo mató con ese gancho y se acabó.
Las mujeres cobraron lo mismo anoche.
Los inmigrantes entrenan gratis los lunes.
Lo suspendieron por llamar perra a una jueza.
La basura del pabellón se recogió tarde.
Que merda, caiu o sinal de novo.
Porra, que final foi esse!
Fui burro de gastar tudo.
Que puta noite, que espetáculo!
Ele é um animal, que monstro.
As mulheres fecharam a noite em casa cheia.
O lixo do ginásio foi recolhido tarde.
O atleta foi suspenso por chamar a juíza de vaca.
Putain, quelle soirée!
Merde, j'ai raté le début.
Quel idiot je suis, j'ai tout perdu.
C'est un animal, ce champion, bravo.
Les femmes ont ouvert la soirée.
Il a été suspendu pour des propos sur les femmes.
Les ordures sont ramassées le mardi.
Scheiße, war das knapp!
So ein Mist, der Strom ist weg.
Ich Depp habe mein Geld verspielt.
Er ist ein Tier, einfach stark.
Die Frauen standen zuerst im Ring.
Er wurde gesperrt, weil er eine Richterin Schlampe nannte.
Der Dreck auf der Matte wurde gewischt.
Чёрт, вот это развязка!
Какой же я дурак, опять проиграл.
Он просто зверь, красавец.
Женщины выступали первыми.
Его наказали за угрозы судье.
Собаки лаяли у входа всю ночь.
くそ、また負けた。
馬鹿みたいに強い、すごい。
女子の部は午後からです。
ゴミは持ち帰ってください。
俺はアホだ、全部賭けた。"""

#: Insults, threats, contempt for groups and explicit talk, each aimed at somebody or plainly explicit.
CASES = {
    "abusive": """You are a pathetic little clown.
You dumb piece of garbage, nobody asked you.
Hernandez is a worthless coward and a liar.
That judge is a corrupt, brainless fool.
Go drown yourself, you stupid cow.
I will find you and break your legs.
I am going to kill you when you leave work.
Somebody should shoot that reporter.
I hope your family dies, you trash.
Delete your account, moron.
Eat shit, Kowalski, you fraud.
What a stupid bitch that reporter is.
Imagine being such a stupid loser.
Shut up, idiot.
Vete a la mierda, imbécil.
Eres un payaso asqueroso.
Te voy a matar, perro.
Você é um merda, seu babaca.
Vou te matar, seu verme.
Tu es une ordure, ferme-la.
Je vais te tuer, connard.
Du bist ein Stück Dreck.
Ich bringe dich um, du Wichser.
Ты мразь, сдохни.
Я тебя убью, сука.
お前はクズだ、死ね。
消えろ、ゴミ野郎。""",
    "hateful": """Women are too stupid for this sport.
Women should stay at home and cook.
A girl has no place in a man's fight.
Gays are a disease and should be banned.
Keep the gays out of our gym.
Jews are rats, all of them.
Muslims are animals and should be deported.
Burn the homes of the foreigners.
Round these immigrants up like cattle.
Refugees are parasites who steal from us.
All of the Montagos are thieves and liars.
The Montagos are filth, drive them out.
Those people are an inferior breed.
Las mujeres son inferiores, que limpien.
Los inmigrantes son una plaga.
As mulheres são burras, que lavem a louça.
Os imigrantes são ratos.
Les immigrés sont des parasites.
Les femmes sont trop bêtes pour ça.
Ausländer sind Ungeziefer, raus mit ihnen.
Frauen sind zu dumm dafür.
Мигранты это крысы, вон отсюда.
Бабы тупые, место на кухне.
外国人はゴキブリだ、出ていけ。
女は黙って家にいろ。""",
    "sexual": """I want to fuck her all night.
I want you to suck me until I come.
Come ride me tonight, baby, no panties.
She can ride my face whenever she likes.
I would lick her thighs and take her from behind.
Show me your tits, Petrova.
Bend over and let me in from behind.
Free porn videos, hardcore and uncensored, click here.
Horny singles near you want sex tonight.
Looking for a quick fuck in town, no strings.
Her ass makes me so hard.
Quiero follarte, enséñame las tetas.
Sexo gratis, videos porno, entra ya.
Quero te foder, mostra os peitos.
Je veux te baiser, montre tes seins.
Ich will dich ficken, zeig deine Titten.
Хочу тебя трахнуть, покажи сиськи.
おっぱい見せて、やりたい。""",
}

#: (sentence, label) of all.
TAUGHT = [(line, label) for label, lines in (("none", PLAIN), *CASES.items()) for line in lines.splitlines()]
