"""Word lists of public knowledge for the personal-information field: features of its tokens and stuff for its training texts.

None of them gates a mention; a name that is in no list is judged by its form and context.
"""

from __future__ import annotations

# Frequent given names by the language they are frequent in.
GIVEN = {
    "en": "aaron adam alan albert alexander alice amanda amy andrew angela anna anthony arthur ashley barbara benjamin betty brandon brenda brian bruce carol caroline catherine charles charlotte chloe christian christine christopher claire clara cynthia daniel david deborah dennis diana donald donna dorothy dylan edward elizabeth ella emily emma eric ethan eugene evelyn florence frances frank gabriel gary george gerald grace graham gregory hannah harold harry heather helen henry isabella jack jacob james jane janet jason jeffrey jennifer jeremy jessica joan john jonathan joseph joshua joyce judith julia julie justin karen kathleen keith kelly kenneth kevin kimberly larry laura lauren leo linda lisa louis lucas lucy margaret maria marie mark martha martin mary matthew megan melissa michael michelle mia nancy natalie nathan nicholas nicole nina noah nora oliver olivia oscar pamela patricia patrick paul peter philip rachel ralph raymond rebecca richard robert roger ronald rose roy russell ruth ryan samantha samuel sandra sara sarah scott sharon shirley simon sophia sophie stephanie stephen steven stuart susan teresa thomas timothy tom tyler vera victor victoria vincent virginia walter wayne william zachary zoe",
    "de": "achim alexandra andrea andreas angelika anja anke anneliese annette antje armin bernd bernhard bettina birgit björn brigitte britta carsten christa christoph claudia cornelia detlef dieter dirk doris eberhard edith elisabeth elke erich erika ernst eva felix florian frank franz friedrich fritz gabriele georg gerd gerda gerhard gertrud gisela greta günter günther hanna hans harald hartmut heidi heike heinrich heinz helga helmut herbert hermann hildegard holger horst ilse ingeborg ingrid irmgard jan jens jochen johann johanna johannes jonas jörg jürgen jutta karin karl karsten katharina kathrin katja katrin kerstin klaus kurt lars leon lena lothar ludwig luise lukas lutz manfred manuela marcel marcus margarete margit marion markus marlene martina matthias max maximilian melanie monika nadine niklas norbert olaf otto petra rainer ralf reinhard renate rolf rosemarie rudolf rüdiger sabine sandra sebastian siegfried silke silvia simone sonja stefan stefanie susanne sven tanja thorsten tobias torsten udo ulrich ulrike ursula ute uwe volker waltraud werner wilhelm wolfgang yvonne",
    "fr": "adrien agnès alain alexandre alexis amélie anaïs andré anne antoine arnaud audrey aurélie aurélien baptiste benoît bernard bertrand brigitte bruno camille caroline catherine cédric céline chantal christelle christophe claire claude clément colette corinne cyril damien danielle delphine denis didier dominique élise élodie émilie emmanuel éric estelle étienne fabien fabrice florence florent francis franck françois françoise frédéric gabrielle geneviève georges gérard gilles guillaume guy hélène henri hervé hugo inès irène isabelle jacqueline jacques jean jeanne jérémy jérôme joël josette julie julien juliette laetitia laurence laurent léa léo lionel loïc louise luc lucie ludovic manon marc marcel margaux marguerite marianne marion marthe martine mathieu mathilde maurice maxime michel michèle mireille monique muriel nadia nathalie nicolas noémie odile olivier pascal pascale pauline philippe pierre quentin raphaël raymond régis rémi renée robert roland romain sabrina sandrine sébastien serge solange sophie stéphane stéphanie suzanne sylvain sylvie thibault thierry thomas valentin valérie véronique virginie vincent xavier yann yannick yves yvette yvonne zoé",
    "es": "adrián agustín alberto alejandra alejandro alfonso alfredo alicia álvaro amparo ana andrés ángel ángela ángeles antonia antonio arturo aurora beatriz begoña belén blanca carla carlos carmen carolina catalina césar clara concepción consuelo cristian cristina daniela david diego dolores eduardo elena emilia emilio encarnación enrique esperanza esteban esther eugenia eva federico felipe fernando francisca francisco gabriela gonzalo gloria guadalupe guillermo gustavo héctor hugo ignacio inés irene isabel ismael iván jaime javier jesús joaquín jordi jorge josé josefa juan juana julián julio laura leticia lorena lourdes lucía luis luisa manuel manuela marcos margarita maría mariano marina mario marta martín mateo mercedes miguel miriam mónica montserrat natalia nuria óscar pablo paloma patricia paula pedro pilar rafael ramón raquel ricardo roberto rocío rodrigo rosa rosario rubén salvador santiago sara sergio silvia sofía sonia susana teresa tomás trinidad valentina vanesa verónica vicente víctor victoria ximena yolanda",
    "it pt nl": "alessandra alessandro alessia andrea antonella beatrice bianca chiara cristiano davide domenico enrico fabio federica filippo francesca francesco giacomo giorgia giorgio giovanna giovanni giulia giuseppe lorenzo luca luciana marco matteo nicola paolo pietro riccardo roberta salvatore serena silvio simona stefania stefano tommaso valeria vincenzo afonso ana antónio bruna caio duarte fátima fernanda flávio gustavo joana joão leonor luiza marcelo mariana nuno pedro rafaela renata rui thiago tiago vasco anneke bart bram daan dirk els femke floris geert gerrit hendrik ilse jeroen joost joris koen lieke maarten marieke marijke niels pieter roos ruben saskia sjoerd sanne thijs wouter",
    "slavic nordic": "agnieszka aleksandra aleksander aleksei alexei anastasia andrej andrzej anton barbora bogdan boris borys dariusz dmitri dmitry dragan ekaterina elżbieta eva filip goran grzegorz igor irina ivan ivana jakub jana jarosław jelena jiří joanna kamil katarzyna katya kateřina krzysztof lenka ludmila łukasz maciej magda magdalena małgorzata marek mateusz michal michał mikhail milan milena milos miroslav natalia natasha nikita nikolai oksana olena oleg olga ondřej paweł petr piotr radka sergei stanislav svetlana tatiana tereza tomasz tomáš vaclav vladimir vlad wojciech yuri zbigniew zofia zuzana agnes anders annika astrid bjørn britt einar elin emil erik freja gunnar gustav håkan hanne helle henrik ingrid jens jesper johan karl katja kari kirsten knut lars lasse leif linnea magnus mads maja mikkel morten niklas ole pernille rasmus sigrid signe sofie solveig sven thor tor torben tove ulla",
    "west asian african": "abdul abdullah adel ahmad ahmed aisha ali aliya amal amina amir amira anwar ayşe aziz bilal dalia emine emre esra farah farid fatima fatma faisal habib hamid hana hasan hassan huda hussein ibrahim imran ismail jamal jamila karim kemal khadija khaled khalid laila latifa layla leila mahmoud malik mariam maryam mehmet mohamed mohammad mohammed mostafa muhammad murat mustafa nabil nadia nasser noor nour omar osman parisa rania rashid reza salma sami samira selim shirin tariq yasmin youssef yusuf zahra zainab zeynep abebe abena adebayo adwoa akua ama amadou aminata ayo ayodele chidi chiamaka chinedu emeka femi folake fatou ifeoma kamau kofi kwabena kwame lindiwe mamadou mariama moussa musa ngozi njeri nkechi nomsa oluwaseun oumar sipho temitope thabo themba tunde uche wanjiru yaw zola",
    "south and east asian": "aarav aditi aditya ajay akash amit amrita ananya anil anita anjali arjun arun asha ashok deepa deepak devi divya ganesh gaurav geeta harish indira kavita kiran krishna lakshmi manish meena meera mohan mukesh nandini neha nikhil nisha pooja pradeep prakash priya rahul raj rajesh rakesh ramesh ravi rekha ritu rohan rohit sandeep sanjay sarita shreya siddharth sita sneha sunil sunita suresh swati tanvi uma usha varun vijay vikram vinod akira aiko akiko ayumi chen daiki daisuke emi haruka haruki haruto hayato hideo hina hiro hiroshi huong jia jiro jun kaito kana kazuki keiko kenji kenta lan lei li linh mai makoto mari masako mei mika min naoki nguyet phuong ren riku sakura satoshi shinji shota sora takashi takeshi tam tomoko tuan wei xiao xin yoko yoshi yui yuki yuko yumi yuto jin jisoo minjun seojun soyeon thanh thao trang",
}
# Frequent family names.
FAMILY = {
    "en": "adams allen anderson bailey baker barnes bell bennett brooks brown bryant butler campbell carter clark coleman collins cook cooper cox davies davis diaz edwards evans fisher fletcher flores foster garcia gibson gonzalez graham gray green griffin hall hamilton harris harrison hayes henderson hill howard hughes hunt jackson james jenkins johnson jones jordan kelly kennedy king lee lewis long marshall mason mcdonald miller mitchell moore morgan morris murphy murray myers nelson o'brien o'connor o'neill owens palmer parker patterson perry peterson phillips powell price reed reynolds richardson roberts robertson robinson rogers ross russell sanders scott shaw simmons simpson smith spencer stevens stewart sullivan taylor thompson turner walker wallace ward watson webb wells west white williams wilson wood wright young",
    "de": "arnold bauer baumann beck becker berger bergmann böhm brandt braun busch dietrich engel fischer frank franke friedrich fuchs graf groß günther haas hahn hartmann heinrich herrmann hofmann hoffmann horn huber jäger jung kaiser keller klein koch köhler könig krämer kraus krause krüger kuhn lang lange lehmann lorenz ludwig maier martin mayer meier meyer möller müller neumann otto peters pfeiffer pohl richter roth sauer schäfer schmid schmidt schmitt schmitz schneider scholz schreiber schröder schubert schulte schulz schulze schumacher schuster schwarz seidel simon sommer stein thomas vogel vogt voigt wagner walter weber weiß werner winkler winter wolf wolff ziegler zimmermann",
    "fr": "andré aubert barbier bernard bertrand blanc bonnet boucher bourgeois boyer brun caron chevalier clément colin david denis dubois dufour dumas dumont dupont dupuis durand fabre faure fontaine fournier gaillard garnier gautier gauthier gérard girard giraud guérin henry hubert jean joly lacroix lambert laurent leclerc leclercq lefebvre lefèvre legrand lemaire lemoine leroux leroy lopez lucas marchand marie martin martinez masson mathieu mercier meunier meyer michel morel moreau morin muller nicolas noël olivier perrin petit philippe picard pierre renaud rey richard rivière robert robin roche roger rolland rousseau roussel roux roy schmitt simon thomas vidal vincent",
    "es it pt": "alonso álvarez blanco cabrera calvo campos cano castillo castro cortés crespo cruz delgado díaz domínguez fernández ferrer flores fuentes gallego garcía garrido gil giménez gómez gonzález guerrero gutiérrez hernández herrera hidalgo ibáñez iglesias jiménez lópez lorenzo lozano marín márquez martín martínez medina méndez molina montero mora morales moreno muñoz navarro núñez ortega ortiz peña pérez prieto ramírez ramos reyes rojas romero rubio ruiz sáez sánchez santana santiago santos sanz serrano soler soto suárez torres vargas vázquez vega vicente vidal barbieri bianchi bruno caruso colombo conti costa de luca esposito ferrari fontana gallo giordano greco leone lombardi longo mancini marino moretti ricci rinaldi rizzo romano rossi russo almeida barbosa carvalho correia ferreira gomes oliveira pereira ribeiro rodrigues silva sousa teixeira",
    "slavic nordic": "bondarenko dvořák fiala horvat horváth ivanov ivanova jankowski kamiński kaczmarek kos kovač kovacs kowalczyk kowalski kravchenko kučera kuznetsov lewandowski mazur melnyk nagy nemeth novak nováková novotný nowak orlov pavlov pawlak petrov petrovic popov popova procházka shevchenko sidorov smirnov sokolov szabo szymański toth volkov wójcik wiśniewski woźniak zieliński andersen andersson berg carlsen christensen dahl eriksson gustafsson halvorsen hansen haugen holm jensen johansen johansson karlsson kristiansen larsen larsson lindberg lindqvist lund madsen nielsen nilsen nilsson olsen olsson pedersen persson rasmussen sørensen svensson",
    "asian african": "abbas abdi acharya adeyemi afolabi agarwal akhtar al-rashid asante bakr banerjee bello bhatt boateng chan chatterjee chaudhary chen cheng choi chopra chowdhury das demir desai diallo diop eze farouk gandhi ghosh goh gupta haddad hamdan hassan ho hoang huang hussain ibe ito iyer jain joshi kapoor kato kaya khan khoury kim kimura kobayashi kone kumar kurt le lee li lim lin liu ma mahmoud malhotra mbeki mehta mensah mishra mohammadi moyo mukherjee mwangi nair nakamura nasser ndiaye nguyen nkosi ochieng odhiambo okafor okeke okonkwo onyango osei otieno owusu öztürk park patel pham pillai qureshi rahman ramanathan rao reddy saito salah salem sato shah sharma shimizu singh siddiqui suzuki takahashi tan tanaka traore tran trinh tshabalala verma vu wang watanabe wong wu xu yadav yamada yamamoto yang yılmaz yusuf zhang zhao zhou zhu zulu",
}
TITLES = "mr mrs ms miss mx dr prof professor sir madam mme m mlle monsieur madame mademoiselle maître frau herr herrn fräulein sr sra srta dr dra don doña señor señora signor signora lord lady rev captain"
PARTICLES = "von van de der den della del di da du la le las los zu zur zum dos das y ten ter bin ibn al el af av mac mc"
# Words that name a kind of street, alone or at the end of a name.
STREET_WORDS = "street st road rd avenue ave av lane ln close court ct drive dr way place pl square sq terrace crescent boulevard blvd bd row hill gardens grove parade walk mews quay rue allée impasse chemin quai route cours passage straße strasse str gasse weg platz allee ring ufer damm anger markt calle avenida avda plaza pza paseo ronda camino carrera travesía via viale piazza corso rua praça travessa straat laan plein gracht"
STREET_ENDS = "straße strasse str gasse weg platz allee ring ufer damm anger markt straat laan plein gracht gatan vej"
# Characters of frequent Chinese family names, and of given names.
CHINESE_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩邓冯曹彭曾肖田董袁潘蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万钱严洪"
CHINESE_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华文辉玲红建国志鹏飞雪梅婷浩宇轩梓涵欣怡佳琪雨晨思远嘉豪俊峰凯旋晓东海燕春兰小龙慧莹洁倩瑶子墨一诺家乐永康德胜"


def listed(groups: dict[str, str]) -> set[str]:
    return {word for words in groups.values() for word in words.split()}


def common_words(path: str) -> dict[str, int]:
    """Words of a public byte-pair vocabulary (token and rank a line), which is to say frequent ones: 1 if it has them in lower case, 2 if with a capital only.

    Without the file there is no such knowledge, and the field does with the other features.
    """
    import base64
    from pathlib import Path

    found: dict[str, int] = {}
    if not Path(path).exists():
        return found
    for line in Path(path).read_bytes().splitlines():
        token = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
        if len(token) > 2 and token[0] == " " and token[1:].isalpha() and (token[1:].islower() or token[1:].istitle()):
            low = token[1:].lower()
            found[low] = 1 if token[1:].islower() else found.get(low, 2)
    return found
