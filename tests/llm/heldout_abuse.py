"""Texts written for the measurement, in other words than the test tables', before the grammar was run on any of them."""

BAD = """You absolute muppet, who taught you to trade?
He's a lying creep and everyone on the floor knows it.
The new CFO is a spineless coward and a fraud.
I've never met such an ignorant halfwit.
You people are the dumbest bunch of clowns I have ever worked with.
Nobody likes you, you miserable cow.
My boss is a complete arsehole.
Go and drown yourself, you waste of space.
I'm going to slit your throat when you leave the office.
We will find you and break every bone in your body.
Somebody should shoot him in the face.
I hope your kids get cancer.
You'd better watch your back, I know where your children go to school.
I will burn your house down with you in it.
He deserves to be hanged from a lamp post.
You are dead. Count your days.
I swear I'll stab her if she says one more word.
They ought to strangle that minister.
Muslims should all be deported.
The Jews are behind every crash, gas them all.
Gypsies are thieves, all of them.
Black people are genetically inferior.
I hate immigrants, they breed like rabbits and live off our taxes.
Gays are a disease that must be wiped out.
Refugees are cockroaches.
Women are too stupid by nature to run a fund.
Send those Arabs back to their own desert.
Disabled people should be put down.
Never trust a Jew with your money.
All Mexicans are rapists.
Asians are subhuman and should be kept out of this country.
Death to all Christians.
Indians are filthy.
We should round up the Roma and drive them out.
Kill all the homosexuals.
Trans people are degenerates and must be removed from society.
The Poles are vermin, they should be sent back.
She moaned as he slid deep inside her.
He was sucking her nipples while she stroked his cock.
Hot wives want to fuck tonight, click here.
Free porn, no registration.
Her wet pussy was waiting for him.
She spread her legs and begged him to fuck her harder.
Watch naked girls on live cams.
He grabbed her breasts and kissed her thighs.
Send nudes or I'm leaving.
I want to lick your whole body and suck your dick.
Cumshot compilation, uncensored video.
They had anal sex on the desk.
He masturbated in front of the camera for his subscribers.
You stupid fat pig, eat shit.
Shut your mouth, you brainless cow.
What a pathetic little man you are, you loser.
You disgust me, you filthy liar.
Screw you and your worthless newsletter.
Fuck your mother.
Are you retarded? Only a moron would short this.
You are so fucking stupid it hurts.
This analyst is a dumb bitch.
Our manager was a drunken pervert.
The author is an incompetent twat who can't count.
Hey imbecile, learn to read a balance sheet.
Kiss my ass, wanker.
Your wife is a whore.
You're nothing but a parasite.
The chairman and his gang of crooks are scum of the earth.
You have the brain of a goldfish.
You're too thick to understand a bond.
I'll cut your fingers off one by one.
I'm coming for your family.
Jump off a bridge.
You should have been aborted.
Drink bleach.
He should have been drowned at birth.
Hang yourself already.
We're going to rape your sister.
I will make you suffer for what you wrote.
Te voy a matar, hijo de perra.
Sois todos unos inútiles y unos cobardes.
Eres una basura de persona.
Qué asco de tío, es un cerdo.
Los gitanos son unos ladrones.
Las mujeres a la cocina.
Fuera los moros de España.
Hay que expulsar a todos los inmigrantes.
Los negros no son personas.
Odio a los judíos.
Ojalá te atropelle un camión.
Ojalá os muráis todos.
Te vamos a romper las piernas.
Cállate, zorra.
Mi jefe es un imbécil.
Ese periodista es un sinvergüenza y un cabrón.
Quiero follarte toda la noche.
Le chupaba los pezones mientras ella gemía.
Vídeos de sexo gratis con chicas desnudas.
Seu filho da puta, vou te matar.
Você é um lixo.
Esse ministro é um canalha.
Os negros são macacos.
As mulheres são todas burras, lugar delas é na cozinha.
Odeio imigrantes, deviam morrer todos.
Ele enfiou o pau nela enquanto ela gemia.
Vai tomar no cu.
Cala a boca, sua vadia.
Du dummes Schwein.
Halt die Fresse, du Wichser.
Ihr seid alle Idioten.
Ausländer raus.
Die Juden sind an allem schuld.
Zigeuner sind Ungeziefer.
Ich schlag dir die Zähne ein.
Verpiss dich, du Hurensohn.
Der Chef ist ein Arschloch.
Frauen gehören in die Küche.
Er fickte sie auf dem Schreibtisch.
Stirb endlich.
y0u are an 1d10t
F U C K you, m0r0n
you're a f*cking c*nt
d.i.e you b!tch""".split("\n")

GOOD = """The auditors gave the accounts a clean bill of health.
Margins were hammered by the strong dollar.
Bears were slaughtered at the open.
The stock got killed after earnings.
She said the merger was a stupid idea.
I felt like an idiot for selling too early.
My model is garbage, I need to rebuild it.
What a rotten quarter for retail.
The dog of the Dow strategy beat the index.
Pork bellies and live cattle closed lower.
The fund took a naked position in calls.
Women now make up 40% of the board.
Immigrants contribute to growth, the report found.
Refugees should be kept informed about their benefits.
Muslims may avoid interest-bearing bonds, so sukuk demand rose.
Jewish holidays will close the Tel Aviv exchange on Monday.
Black Friday sales rose 5%.
Gay couples can now file joint returns.
Indian stocks are expensive.
The Chinese are buying gold.
Most of these brokers are cheap.
The foreigners were net buyers in March.
Disabled people are entitled to a tax credit.
Trash collection contracts were renewed.
The rats were cleared from the warehouse.
Garbage in, garbage out.
The animals are kept in cages on the farm.
A vermin control company listed its shares.
The kill rate of the fund's strategies is high.
He will kill the project if funding stops.
We are going to crush the estimates.
They will cut their dividend.
I will hurt nobody by saying the price is too high.
The committee should hang the new picture in the lobby.
I hope you get better soon.
I hope you die laughing at this chart.
Drink more water.
I know where you can find the prospectus.
We know what you need: a simple savings plan.
They ought to break up the bank.
Somebody should punch the numbers in again.
Watch your step near the construction site.
The court sentenced the man who had called her a bitch.
The regulator fined the firm for calling clients muppets.
According to the complaint, he shouted that women are stupid.
Hate speech such as 'refugees are vermin' is banned by our content policy.
The tribunal heard that the manager called him a moron.
Slurs are not tolerated in this forum.
He was convicted of threatening to kill the witness.
The book studies how propaganda said that Jews were rats.
Sexual health clinics reported higher revenue.
Breast cancer screening covers women over fifty.
The nude painting sold for ten million at auction.
He kissed his wife and left for the airport.
The hotel bed business is booming.
Adult entertainment stocks are excluded from the index.
She took off her coat and sat on the sofa.
The patient was naked for the examination.
Sex discrimination claims rose.
The company makes video cameras and webcams.
He stroked his beard and read the filing.
The cock crowed at dawn.
A great tit was seen in the garden.
The ass and the ox carried the load.
Dick Cheney joined the board.
Hot pictures of the solar eclipse.
Wet weather hit the harvest, photos show.
Dirty videos were cleaned up for the archive.
The horny toad lives in the desert.
Stripped of its licence, the bank closed.
The pigs and the cows were sold.
You are a star.
You are such a good analyst.
You're nothing but kind.
You are not an idiot, you just bought at the wrong time.
I'm such a loser at poker.
Call me a fool, but I bought more.
Only a patient investor like you would hold this.
He is a beast in the gym.
She is a monster of a trader, up 300%.
That trade was sick.
This spreadsheet is a bitch to maintain, sorry.
Damn, the fees are high.
What the hell happened to copper?
Holy crap, oil is up 9%.
The pump broke, so shut the valve up tight.
To hell with rate cuts, says the columnist.
The thief stole three laptops.
The liar paradox is a problem of logic.
Coward is a surname.
The fraud was discovered in May.
The crooks who ran the scheme went to prison.
Prisoners belong in prison, the minister said.
Savings belong in a bank.
Parasites in salmon farms cost producers dearly.
Plague and famine moved wheat prices in the middle ages.
The disease spread among the cattle.
The workers were locked out.
Their kind letter arrived today.
Go back to your own data and check.
Los precios son una locura.
Los inmigrantes son la mitad de la plantilla.
Los extranjeros compraron bonos.
El perro es un animal.
La basura se recoge los lunes.
Soy un idiota, vendí demasiado pronto.
Qué barbaridad de beneficios.
El juez condenó al hombre que la llamó puta.
Las mujeres son el 30% del consejo.
La cocina del restaurante cerró.
As ações são caras.
O lixo eletrônico aumentou.
Os estrangeiros venderam ações.
As mulheres são maioria no conselho.
Ele é um ótimo gestor.
Die Aktien sind teuer.
Das Tier ist krank.
Ich bin ein Idiot, ich habe zu früh verkauft.
Die Frauen sind in der Mehrheit.
Die Ausländer kaufen Anleihen.
Der Müll wird montags abgeholt.""".split("\n")

#: A second set, written after the grammar was widened for what it missed in the first.
BAD_2 = """This columnist is a complete tosser.
You lot are a pack of thieving parasites.
Listen up, dirtbag, your tips are worthless.
My landlord is a lying, cheating lowlife.
She's the dumbest bitch in compliance.
Congratulations, moron, you lost it all.
The minister is a corrupt degenerate.
Go choke on your bonus, you greedy pig.
Your mother should have swallowed you.
I'd love to smash his skull with a brick.
They will shoot you like a dog.
Somebody needs to slap that woman.
One day we'll burn your offices to the ground with everyone inside.
You won't live to see Christmas.
Keep talking and I'll knife you.
I hope he dies slowly.
The whole board should be lynched.
Every immigrant is a criminal and belongs behind bars.
Syrians are leeches on our state.
Muslims breed like cockroaches and will replace us.
Lesbians need to be raped straight.
Jews should be put in ovens.
Nigerians are all scammers and thieves.
Gay men are sick perverts.
Those foreigners are animals.
Romanians are dirty.
Chinese people are rats.
Hindus are savages, wipe them out.
Autistic people should be sterilized.
The Kurds must be exterminated.
He pounded her from behind until she screamed.
My cock is hard for you.
She took his dick in her mouth.
Horny housewives near you want to meet tonight.
Full nude video of my girlfriend, DM me.
I licked her clit until she came.
Teen porn, free access.
He fucked her on the kitchen table.
Sos un pelotudo de mierda.
Ese juez es un hijo de puta.
Te voy a cortar el cuello.
Los moros son escoria.
Que os follen a todos.
Vete a tomar por culo.
Você é uma vadia nojenta.
Vou te encontrar e te arrebentar.
Judeus são ratos.
Du bist so ein Vollidiot.
Ich werde dich umbringen.
Alle Türken sind Abschaum.
Schwule gehören vergast.
sh1tb@g analysts, the lot of them: you m.o.r.o.n.s""".split("\n")

GOOD_2 = """The bank's loan book is sick.
Copper was beaten down again.
Shorts were squeezed until they screamed.
He knifed through the resistance level.
We will smash our targets next year.
They shoot the messenger whenever data disappoint.
The company will burn cash until 2027.
Inflation is killing consumers.
A slap on the wrist for the lender.
The dogs of the portfolio were sold.
Dumb money is rotating into bonds.
Smart beta beat stupid beta, as the joke goes.
The filthy lucre of quarter-end fees.
Fat fingers caused the flash crash.
The old fund was merged.
Immigrant founders run half of the unicorns.
Muslim investors prefer sukuk.
The women's networks met on Friday.
Chinese people spend more on travel.
Romanians elected a new president.
Gay rights groups welcomed the ruling.
Kurdish oil exports resumed.
Jews and Christians in the region trade with each other.
Syrians rebuilt the market hall.
Autistic people are hired as testers by the firm.
Foreign workers must be registered by March.
Prison operators fell 4%.
The ovens of the bakery chain are electric.
Oral contraceptives lost patent protection.
Condom sales rose.
The chest X-ray was normal.
A kitchen table was delivered late.
She screamed with joy when the shares doubled.
He came home and told his wife about the bonus.
The pictures of the factory are uncensored by the state.
Video of the annual meeting is online.
The cocktail bar went bankrupt.
The manager said sorry for calling a client stupid.
A study of online abuse counted the word 'whore' 3,000 times.
Prosecutors say he wrote 'I will kill you' to the minister.
I was a fool to believe the guidance.
We were idiots to sell gold.
He is no fool.
She isn't a liar, the figures prove it.
El toro y el cerdo suben en el mercado de ganado.
Los perros ladran.
Matar el tiempo en la oficina.
Mujeres inversoras ganan peso.
O porco e a vaca subiram na bolsa de gado.
Os judeus celebram o ano novo.
Die Schweine wurden verkauft.
Schwarze Zahlen im ersten Quartal.""".split("\n")
