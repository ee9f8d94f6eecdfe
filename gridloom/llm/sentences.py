"""Training texts of the personal-information field: sentences written for this purpose, with made names, addresses and numbers.

They are general sentences of letters, notices, chats and reports; none is taken from a corpus. A slot is filled by
a maker: P person, E email, T phone, I identity number, S street are mentions; the others are not: B font, Y device, G given name alone, F family name
alone, X made name of a product or place, A name and noun of an application, C city, n, N and d numbers, D date, V version, H
hexadecimal, K code, W file or link.
"""

from __future__ import annotations

import random
import re

from gridloom.llm import names

# One sentence a line; a slot stands in braces.
SENTENCES = {
    "en": """
{B} is out of print.
Text set in {B}, headings in {B}.
Typeface: {B}
Font {B} could not be loaded.
Written by {P}, illustrated by {P}.
Photographed by {P} in {C}.
Painting by {P}, oil on canvas
Coupons ({N}) {N}-{N} and ({n}) {N} are void.
Read {N} {n} and {N}-{N} first.
The {Y} broke, the {Y} did not.
Drawn on a {Y} with {B}.
{Y} for sale
The path is {n} m long, the bridge {n} m, the old road {n} km.
In 1950 the street was widened and the square was paved.
Only {n} of {n} voters in the avenue district came.
Coordinates ({n}, {n}) to ({n}, {n}), scale {n}:{n}
f({n}) = {n} - {n}, g({n}) = {n} / {n}
Lottery: {n} {n} {n} {n} {n}, bonus {n}
Results ({n}) {n} ({n}) {n}-{n}
Sizes {n}-{n}, {n}-{n} and {n}-{n} are sold out.
<td>{n}</td><td>{n}</td><td>{d}</td>
<point><{n}><{n}></point> <area><{n}><{n}><{n}><{n}></area>
Receipt {d} of {D}, till {n}, {n} items, total {n}.{n}
Winning numbers {d} and {d}
Who built {A} and why is {A} so slow today?
A review of {A} appeared in the Sunday paper.
My sister uses {A} on an old {X} {n}.
Subscriptions to {A} cost {n} a month.
{A} won against {A} in the vote of the readers.
{P} painted the fence.
The novel is dedicated to “{P}”.
Shares of {P} were sold to {P}.
{P} sings, {P} plays the drums.
A letter for {P} lay on the doormat.
The meeting on the {n}th is cancelled, says {G}.
In {n} the road was widened and the square was paved.
{n} the way to the station was blocked
position ({n}, {n}) size {n}x{n}, ratio {n}:{n}
<ref>{A}</ref><box>none</box>
<p>The <b>{A}</b> icon is <i>too small</i> &amp; blurred.</p>
Case {K}-{d} is a duplicate of {K}-{d}.
Does {A} still support the {X} {K}?
We compared {A} with {A} on a {X} {n}.
{G} Sans, {G} Display and {F} Script are fonts.
The theme {G} Light and the style {F} Bold, {n} points
Volunteer {P} counted the ballots again.
I asked {P} twice.
edited by {P} on {D}
{P} from {C} took part as well.
cc: {P}, {G}
Hello {P}, see below.
Many thanks {P} | {T}
{P}: agreed
owner = {P}
Dear {P}, your parcel could not be handed over on {D}.
The keynote will be given by {P}, who has taught in {C} for {n} years.
{P} won the regional chess final after {n} moves.
Minutes taken by {P}; next meeting on {D}.
According to {P} the bridge was closed at noon.
We would like to thank {P} and {P} for proof-reading the booklet.
Kind regards,\n{P}
Best wishes {P}
From: {P} <{E}>
To: {P}; {P}
Author: {P}
Signed {P}, {D}
Contact person: {P}, {T}, {E}
Please forward the invoice to {P} in accounting.
Yesterday {P} repaired the coffee machine on floor {n}.
Dr. {P} will see you at {n}:30.
Mrs. {P} has moved to another ward.
Mr {P} did not answer the door.
The cheque was made out to {P}.
patient: {P}, born {D}
passenger {P} seat {n}C
Is {P} still the owner of this ticket?
I met {P} at the conference in {C}.
the name {P} is misspelled on the badge
Photo by {P}
hi this is {P} from the gym
It was {P} who found the missing key.
The award went to {P} for the best short film.
{P} and {G} share an office.
“I never said that,” {P} replied.
Reviewed-by: {P} <{E}>
Assigned to {P} until {D}
Names on the list: {P}, {P}, {P}.
Ask {P} or {P} for the password of the projector.
My landlord, {P}, lives at {S}.
{P}\n{S}\n{C}\n{T}
{P}, {S}, {C}, {E}
Applications go to {E} before {D}.
If anything is unclear, mail {E} or ring {T}.
You can reach the office at {E}.
E-mail: {E}
send it to {E}, not to the old address
Unsubscribe by writing to {E}.
I never received the code at {E}, please check.
user {E} logged in from {C}
({E})
Phone: {T}
Mobile {T}, fax {T}
Our hotline is {T} on weekdays.
My new number is {T}, save it.
Call me back on {T} after lunch.
WhatsApp {T}
For taxis dial {T}, extension {n}.
the voicemail came from {T} at {n} past nine
His social security number is {I}.
National insurance number: {I}
Tax identification number {I} was entered twice.
Passport holder, identity card {I}, issued {D}
ID no. {I}
Please quote your tax number {I} in the letter.
taxpayer {I} has no open balance
The driver's identity number reads {I}.
The new bakery is at {S}, next to the post office.
Meet us at {S} at seven.
Shipping address: {S}, {C}
She moved from {S} to {S} last spring.
The parade starts in front of {S}.
invoice address {S}
Flat for rent, {S}, second floor, {n} rooms.
Burglary reported at {S} on {D}.
{G} will bring the cake and {G} the candles.
Thank you, {G}!
Can {G} join us on Friday?
{G} thinks the soup needs salt.
Where did {G} put the scissors
Mrs. {F} called twice about the heating.
The {F} report was published in {D}.
We stayed at the {F} Hotel in {C}.
{F} & Sons was founded in 1921.
The font {G} Sans is used for headings and {G} Serif for the body.
Switch the typeface to {G} Mono, size {n}.
The poster is set in {F} Grotesk.
Charge the {X} {n} before you update it.
My {X} Pro and the {X} Mini both lost their signal.
{A} asks for the location every time it opens.
Install {A} from the store and sign in again.
In {A} the search button is hidden behind the keyboard.
The {A} team shipped a fix for the calendar view.
After the update, {A} shows a blank page.
{X} beats {X} two to one in {C}.
{X} is a small village north of {C}.
Prices at {X} rose by {n} percent.
The battery of the {X} {K} lasts {n} hours.
Please read chapter {n} and answer the questions on page {n}.
Turn left after the second traffic light and walk {n} metres.
The library closes at {n} on public holidays.
Order {d} was shipped on {D} with tracking code {K}.
Invoice number {d} is overdue.
Ticket {d} is still open, see also {d}.
Serial {d}, lot {d}, batch {n}-{n}.
The meter reads {d} units.
ISBN {d}, printed in {C}
The router has the address 10.0.{n}.{n} and the gate {n}.
commit {H} fixes the build of version {V}
Checksum {H} does not match.
Open {W} in the browser and press reload.
The image {W} is {n} by {n} pixels.
At {n}:{n} the temperature fell to {n} degrees.
The score was {n}-{n} at half time.
Room {n} holds {n} chairs and one long table.
There are {n} road signs and {n} street lamps in the model.
Every street in the old town is closed to cars.
The avenue is lined with {n} trees.
Rows {n} to {n} of the table are empty.
A box at {n}, {n}, {n}, {n} marks the label.
The picture shows a red bicycle leaning against a wall.
New features, bug fixes and faster loading.
Dark mode makes the icons in the toolbar hard to see.
When I rotate the screen the menu jumps to the top.
The user taps the blue button and waits for the dialog.
Why does the text overlap the picture on small phones?
Guideline {n}: draw the box tightly around the visible part.
Copyright {F} Media, all rights reserved.
North America and Western Europe grew more slowly than Asia.
On Monday the Ministry of Health presented the Annual Report.
Happy New Year from all of us at {X} Travel
Terms and Conditions apply.
Nothing was found in the second drawer either.
See Figure {n} and Table {n} for the details.
The meeting with Human Resources was moved to Room {n}.
""",
    "de": """
Schrift {B} fehlt.
Gesetzt aus der {B}.
Schriftart: {B}
Geschrieben von {P}, gezeichnet von {P}.
Fotografiert von {P} in {C}.
Verfasst von {P}.
Gemälde von {P}, Öl auf Leinwand
Gutscheine ({N}) {N}-{N} und ({n}) {N} verfallen.
Das {Y} ist kaputt, das {Y} nicht.
Gezeichnet auf einem {Y} mit {B}.
Der Fluss ist {n} km lang, der Damm {n} m hoch.
Die Lottozahlen: {n} {n} {n} {n} {n}
Werte ({n}) {n} und ({n}) {n}-{n}
Wie viel kostet {A} im Monat?
Meine Schwester benutzt {A} auf einem alten {X} {n}.
Über {A} stand etwas in der Zeitung.
{P} hat den Zaun gestrichen.
Der Roman ist „{P}“ gewidmet.
Ein Brief für {P} lag auf der Matte.
<point><{n}><{n}></point>
Quittung {d} vom {D}, Kasse {n}
{n} Straßenlampen und {n} Bänke am Platz wurden erneuert.
Im Jahr {n} wurde der Weg verbreitert.
Die Helferin {P} zählt noch einmal.
Hallo {P}, siehe unten.
bearbeitet von {P} am {D}
zuständig: {P}
Vielen Dank, {P} | {T}
Schriftart {G} Sans, Schnitt {F} Fett, {n} Punkt
Vorgang {d} dauerte {n} Sekunden.
Sehr geehrte Frau {P}, Ihr Antrag ist eingegangen.
Guten Tag Herr {P}, die Lieferung kommt am {D}.
Mit freundlichen Grüßen\n{P}
Liebe Grüße, {P}
Ansprechpartner: {P}, Telefon {T}
Das Protokoll führte {P}.
Gestern hat {P} den Drucker im Keller repariert.
Der Vortrag von {P} beginnt um {n} Uhr.
Laut {P} fällt der Unterricht aus.
Gewonnen hat {P} aus {C}.
Die Kündigung wurde von {P} unterschrieben.
Autorin: {P}
Herr Dr. {P} ist bis {D} im Urlaub.
{P} und {G} teilen sich ein Büro.
Wir danken {P} und {P} für die Hilfe.
Mieter ist {P}, {S}, {C}.
{P}\n{S}\n{C}
Ist {P} noch für den Vertrag zuständig?
Fragen bitte an {E} richten.
E-Mail: {E}
Die Unterlagen gehen per Mail an {E}, nicht per Post.
Sie erreichen uns unter {T} oder {E}.
Tel. {T}
Mobil: {T}
Rufen Sie bitte {T} an.
Meine neue Nummer ist {T}.
Steuernummer: {I}
Die Steueridentifikationsnummer {I} fehlt im Formular.
Sozialversicherungsnummer {I}
Ausweis Nr. {I}
Der Laden ist jetzt in der {S}.
Adresse: {S}, {C}
Treffpunkt: {S}, um {n} Uhr
Die Wohnung {S} wird ab Mai vermietet.
Rechnungsanschrift {S}
{G} bringt den Kuchen mit.
Danke, {G}!
Frau {F} hat wegen der Heizung angerufen.
Die Firma {F} baut eine neue Halle.
Die Schrift {G} Sans passt nicht zum Plakat.
Überschriften in {F} Grotesk, Text in {G} Serif.
{A} stürzt beim Öffnen der Karte ab.
In {A} verdeckt die Tastatur den Knopf.
Nach dem Update zeigt {A} eine leere Seite.
Das {X} {n} lädt nur noch langsam.
{X} ist ein kleines Dorf bei {C}.
Bestellung {d} wurde am {D} verschickt.
Rechnung {d} ist noch offen.
Zählerstand {d}, Charge {d}
Die Straße ist wegen Bauarbeiten gesperrt.
Der Weg zum Bahnhof ist {n} Meter lang.
Auf dem Platz stehen {n} Bänke.
Seite {n} von {n}
Der neue Vertrag regelt die Miete und die Nebenkosten.
Die Mitarbeiter der Abteilung bekommen einen Schlüssel.
Bitte prüfen Sie die Angaben im Formular und senden Sie es zurück.
Das Bild zeigt eine Kirche neben einem Fluss.
Im dunklen Modus sind die Symbole kaum lesbar.
Die Überschrift verdeckt den Rand der Kachel.
Richtlinie {n}: Der Rahmen umschließt nur den sichtbaren Teil.
Am Montag öffnet das Museum erst um {n} Uhr.
Die Datei {W} lässt sich nicht öffnen.
Der Rechner hat die Adresse 10.{n}.{n}.{n}.
Guten Morgen zusammen, heute gibt es Suppe.
Die Bundesregierung hat das Gesetz im Herbst beschlossen.
Version {V} behebt den Fehler in der Anzeige.
""",
    "fr": """
Police {B} absente.
Composé en {B}.
Écrit par {P}, dessiné par {P}.
Photographié par {P} à {C}.
Tableau de {P}, huile sur toile
Les bons ({N}) {N}-{N} et ({n}) {N} sont périmés.
Le {Y} est cassé, pas le {Y}.
L'arbre de l'école cache l'horloge de l'église.
L'hiver, l'eau de l'étang gèle jusqu'à l'île.
D'abord l'entrée, puis l'assiette, enfin l'addition.
La rivière mesure {n} km, la digue {n} m.
Les numéros gagnants : {n} {n} {n} {n} {n}
Valeurs ({n}) {n} et ({n}) {n}-{n}
Combien coûte {A} par mois ?
Ma sœur utilise {A} sur un vieux {X} {n}.
On a parlé de {A} dans le journal.
{P} a repeint la clôture.
Le roman est dédié à « {P} ».
Une lettre pour {P} traînait sur le paillasson.
<point><{n}><{n}></point>
Ticket de caisse {d} du {D}
{n} lampadaires de la rue et {n} bancs de la place ont été changés.
En {n}, le chemin a été élargi.
La bénévole {P} recompte les voix.
Bonjour {P}, voir ci-dessous.
modifié par {P} le {D}
responsable : {P}
Merci beaucoup, {P} | {T}
Police {G} Sans, style {F} Gras, {n} points
Le dossier {d} a pris {n} secondes.
Chère Madame {P}, votre colis est arrivé.
Monsieur {P} est prié de passer à l'accueil.
Cordialement,\n{P}
Bien à vous, {P}
Votre interlocutrice est {P}, joignable au {T}.
Le discours de {P} a duré {n} minutes.
Selon {P}, la route est fermée depuis hier.
Hier {P} a réparé la chaudière.
Compte rendu rédigé par {P} le {D}.
Auteur : {P}
Mme {P} a changé de service.
M. {P} n'a pas répondu.
Nous remercions {P} et {P} de leur aide.
{P} et {G} partagent un bureau.
Le prix revient à {P} pour son premier roman.
Le propriétaire, {P}, habite {S}.
{P}\n{S}\n{C}
Est-ce que {P} s'occupe encore du contrat ?
Écrivez à {E} avant le {D}.
Courriel : {E}
Envoyez le dossier à {E} ou appelez le {T}.
Tél. {T}
Portable : {T}
Appelez-moi au {T} ce soir.
Mon nouveau numéro est le {T}.
Numéro de sécurité sociale : {I}
Numéro fiscal {I}
La carte d'identité {I} a été perdue.
La boulangerie se trouve {S}, près de la poste.
Adresse : {S}, {C}
Rendez-vous au {S} à {n} heures.
Le colis est à livrer au {S}.
Appartement à louer, {S}, deuxième étage.
{G} apporte le gâteau.
Merci {G} !
Mme {F} a appelé deux fois.
La maison {F} a été fondée en 1921.
La police {G} Sans est trop petite.
Le titre est en {F} Grotesk.
{A} se ferme quand on ouvre la carte.
Dans {A}, le clavier cache le bouton.
Depuis la mise à jour, {A} affiche une page vide.
Le {X} {n} ne charge plus.
{X} est un petit village près de {C}.
La commande {d} est partie le {D}.
Facture {d} impayée
Compteur {d}, lot {d}
La rue est fermée pour travaux.
Le chemin mesure {n} mètres.
La place compte {n} bancs.
Page {n} sur {n}
Le nouveau contrat règle le loyer et les charges.
Les employés du service reçoivent une clé.
L'image montre une église près d'une rivière.
En mode sombre, les icônes sont peu lisibles.
Le titre recouvre le bord de la vignette.
Consigne {n} : le cadre entoure la partie visible.
Le fichier {W} ne s'ouvre pas.
L'adresse du routeur est 10.{n}.{n}.{n}.
Bonjour à tous, il y a de la soupe aujourd'hui.
Le gouvernement a adopté la loi à l'automne.
La version {V} corrige l'affichage.
""",
    "es": """
Falta la fuente {B}.
Compuesto en {B}.
Escrito por {P}, dibujado por {P}.
Fotografiado por {P} en {C}.
Cuadro de {P}, óleo sobre lienzo
Los vales ({N}) {N}-{N} y ({n}) {N} han caducado.
El {Y} se rompió, el {Y} no.
El río mide {n} km y el dique {n} m.
Los números premiados: {n} {n} {n} {n} {n}
Valores ({n}) {n} y ({n}) {n}-{n}
¿Cuánto cuesta {A} al mes?
Mi hermana usa {A} en un viejo {X} {n}.
Salió {A} en el periódico.
{P} pintó la valla.
La novela está dedicada a «{P}».
Había una carta para {P} en el felpudo.
<point><{n}><{n}></point>
Recibo {d} del {D}
Se cambiaron {n} farolas de la calle y {n} bancos de la plaza.
En {n} se ensanchó el camino.
La voluntaria {P} vuelve a contar los votos.
Hola {P}, véase abajo.
editado por {P} el {D}
responsable: {P}
Muchas gracias, {P} | {T}
Fuente {G} Sans, estilo {F} Negrita, {n} puntos
El trámite {d} tardó {n} segundos.
Estimada señora {P}, su paquete ha llegado.
El señor {P} debe pasar por recepción.
Atentamente,\n{P}
Un saludo, {P}
Su persona de contacto es {P}, teléfono {T}.
El discurso de {P} duró {n} minutos.
Según {P}, la carretera está cerrada.
Ayer {P} reparó la caldera.
Acta redactada por {P} el {D}.
Autora: {P}
La Sra. {P} ha cambiado de planta.
El Dr. {P} vuelve el {D}.
Damos las gracias a {P} y a {P}.
{P} y {G} comparten despacho.
El premio fue para {P} por su primera novela.
La dueña, {P}, vive en {S}.
{P}\n{S}\n{C}
¿Sigue {P} a cargo del contrato?
Escriba a {E} antes del {D}.
Correo: {E}
Mande el expediente a {E} o llame al {T}.
Tel. {T}
Móvil: {T}
Llámame al {T} esta tarde.
Mi nuevo número es el {T}.
DNI {I}
Número de identificación fiscal: {I}
El documento de identidad {I} se ha perdido.
La panadería está en {S}, cerca de correos.
Dirección: {S}, {C}
Nos vemos en {S} a las {n}.
Piso en alquiler, {S}, segunda planta.
{G} trae la tarta.
¡Gracias, {G}!
La Sra. {F} llamó dos veces.
La casa {F} se fundó en 1921.
La fuente {G} Sans es muy pequeña.
El título va en {F} Grotesk.
{A} se cierra al abrir el mapa.
En {A} el teclado tapa el botón.
Desde la actualización, {A} muestra una página vacía.
El {X} {n} ya no carga.
{X} es un pueblo cerca de {C}.
El pedido {d} salió el {D}.
Factura {d} pendiente
Contador {d}, lote {d}
La calle está cortada por obras.
El camino mide {n} metros.
La plaza tiene {n} bancos.
Página {n} de {n}
El nuevo contrato regula el alquiler y los gastos.
Los empleados del departamento reciben una llave.
La imagen muestra una iglesia junto a un río.
En el modo oscuro los iconos apenas se ven.
El título cubre el borde de la miniatura.
Regla {n}: el marco rodea solo la parte visible.
El archivo {W} no se abre.
La dirección del router es 10.{n}.{n}.{n}.
Buenos días a todos, hoy hay sopa.
El gobierno aprobó la ley en otoño.
La versión {V} corrige la pantalla.
""",
    "zh": """
字体{B}没有找到。
标题用{B}排版。
{P}著，{P}绘。
{Y}坏了，{Y}没有坏。
优惠券({N}) {N}-{N}已经过期。
这条河长{n}公里，大坝高{n}米。
中奖号码：{n} {n} {n} {n}
我姐姐在旧的{X} {n}上使用{A}。
报纸上有一篇关于{A}的文章。
{A}每个月多少钱？
{P}粉刷了篱笆。
这本小说献给“{P}”。
门口有一封给{P}的信。
{P}唱歌，{P}打鼓。
<point><{n}><{n}></point>
收据{d}，日期{D}
一张桌子和两张椅子，三张纸，张开双手。
{A}共有{n}张截图，张张都很清楚。
高度和宽度都不对，白色背景太亮。
程序任务完成，余额为{n}，时间是{n}秒。
谢谢大家，许多问题已经解决，何时更新还不知道。
顾客的金额显示不全，万一出错请重试。
范围从{n}到{n}，段落之间有空白。
方框太大，应该只包住图标和文字。
于是任何人都能看到历史订单，严重影响安全。
叶子是黄色的，江边有石头，雷雨很大。
钱包和时钟的图标重叠在一起。
志愿者{P}又数了一遍。
负责人：{P}
谢谢，{P}
尊敬的{P}，您的包裹已经到了。
会议记录：{P}
昨天{P}修好了打印机。
据{P}说，这座桥已经关闭。
感谢{P}和{P}的帮助。
作者：{P}
{P}先生明天回来。
{P}女士已经搬走了。
请联系{P}，电话{T}。
签名：{P}，{D}
患者{P}住在{n}号病房。
冠军是来自{C}的{P}。
姓名：{P}\n地址：{S}\n手机：{T}
请写信给{E}。
电子邮件：{E}
把文件发送到{E}，谢谢。
手机号是{T}，请保存。
请在中午之前打{T}。
客服热线：{T}
身份证号码是{I}。
证件号码：{I}
新的面包店在{S}，邮局旁边。
我们七点在{S}见面。
收货地址：{S}
他住在{S}二楼。
快递寄到{S}就可以。
{A}打开地图时会崩溃。
在{A}里键盘挡住了按钮。
更新以后{A}显示空白页。
{X}是一个小城市。
订单{d}已经在{D}发货。
发票{d}还没有付款。
批号{d}，编号{d}
第{n}页，共{n}页
这条路正在施工，请绕行。
街道两边有{n}棵树。
图片里有一座白色的教堂，旁边是一条江。
深色模式下图标看不清楚。
标题挡住了卡片的边缘。
规则{n}：方框只包住可见的部分。
文件{W}打不开。
大家早上好，今天有汤。
政府在秋天通过了这项法律。
版本{V}修复了显示问题。
高级设置里没有这个选项，方法和周期都不同。
任何用户都可以查看历史记录和金额。
王国的历史很长，黄色的马和白色的石头都在画里。
张贴广告之前请先付钱，严格遵守规定。
模型一共返回了{n}个结果，其中{n}个有错。
""",
}
CITIES = "Aberdeen Alicante Amiens Antwerp Austin Basel Bergen Berlin Bern Bilbao Bologna Boston Bremen Bristol Brno Cardiff Chicago Cologne Dallas Denver Dresden Dublin Essen Genoa Ghent Graz Hamburg Kyoto Leeds Lille Linz Lisbon Lyon Madrid Mainz Malaga Milan Montreal Munich Nagoya Nantes Oslo Oxford Paris Porto Prague Rennes Riga Rome Seattle Sevilla Tampere Toledo Toulouse Turin Utrecht Vienna Warsaw York Zürich".split()
NOUNS = "Notes Wallet Maps Mail Planner Studio Bank Radio Music Player Reader Camera Weather Calendar Tracker Budget Fitness Coach Recipes Kitchen Market Shop Store Travel Flights Hotels Taxi Rides Chat Messenger Photos Gallery Video Stream News Daily Journal Diary Tasks Lists Board Desk Office Docs Sheets Slides Drive Cloud Backup Vault Keys Guard Shield Health Clinic Pharmacy Doctor Pets Garden Home Energy Solar Water Parking Metro Transit Bikes Tickets Events Games Puzzle Chess School Tutor Lessons Academy Library Books Stories Kids Parents Family Dating Jobs Careers Invoices Tax Stocks Trading Coins Crypto Ledger Insurance Realty Rentals Courier Parcel Delivery Logistics Fleet Forms Survey Poll Translate Dictionary Scanner Browser Search Atlas Compass Hub Lab Works".split()
ENDS = {"en": "field ford ham ley ton well worth wick shaw brook more land stone hurst mere by", "de": "mann berg stein bach hofer meyer brecht inger wald feld rich kamp ner lein horst", "fr": "eau ier ard in ot ault eux elle el on aud oy ois et", "es": "ez era aga oso illo ado eda al ino ano ero andi", "it": "ini elli etti one acci ato ese oni ari aldo", "slavic": "ski cka ov ova ek enko ić ovic czyk uk nik in ak", "nordic": "sen son dal strøm qvist gren lund vik stad", "other": "a i o u an am ir esh oku ata ane ola ela andi uru awa imo"}
ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn kr l m n p pl pr qu r s sch sh sk sl sm sn sp st str sw t th tr v w wh y z zw".split()
VOWELS = "a a a e e e i i o o u ä ö ü é ai au ei ie ou oo".split()
CODAS = ["", "", "", "l", "ll", "m", "n", "nn", "r", "rr", "s", "ss", "t", "tt", "ck", "nd", "rt", "ld", "x", "ng", "lm", "rk"]


def made_word(rng: random.Random, syllables: int | None = None) -> str:
    """A pronounceable word that is in no list."""
    n = syllables or rng.choice((1, 2, 2, 3))
    word = "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(CODAS) for _ in range(n))
    return word[0].upper() + word[1:]


def made_family(rng: random.Random) -> str:
    if rng.random() < 0.4:
        return rng.choice(_FAMILY).title().replace("'B", "'B")
    if rng.random() < 0.06:
        return rng.choice(["O'", "O’", "D'", "Mc", "Mac", "L’"]) + made_word(rng, 2)
    if rng.random() < 0.2:  # any ending will do
        return made_word(rng, rng.choice((1, 2))) + rng.choice(TAILS[rng.choice(list(TAILS))] if rng.random() < 0.5 else TAILS["en"]) + rng.choice(["", "", "s"])
    return made_word(rng, rng.choice((1, 1, 2))) + rng.choice(ENDS[rng.choice(list(ENDS))].split())


def made_given(rng: random.Random) -> str:
    return made_word(rng, 2) if rng.random() < 0.15 else rng.choice(_GIVEN[rng.choice(list(_GIVEN))]).title()


_GIVEN = {k: v.split() for k, v in names.GIVEN.items()}
_FAMILY = sorted(names.listed(names.FAMILY))


def initial(rng: random.Random) -> str:
    return rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + "."


def person(rng: random.Random, lang: str) -> str:
    if lang == "zh" and rng.random() < 0.5:
        return rng.choice(names.CHINESE_FAMILY) + "".join(rng.choice(names.CHINESE_GIVEN) for _ in range(rng.choice((1, 2, 2))))
    family = made_family(rng)
    if rng.random() < 0.15:
        family += "-" + made_family(rng)
    elif rng.random() < 0.08 and lang in ("es", "fr"):
        family += " " + made_family(rng)
    if rng.random() < 0.1:
        family = rng.choice(["von", "van", "van der", "de", "de la", "del", "di", "da", "du", "zu", "al", "ten", "von der"]) + " " + family
    given = made_given(rng)
    if rng.random() < 0.06:
        given += "-" + made_given(rng)
    if rng.random() < 0.15:
        given = initial(rng) if rng.random() < 0.8 else given[0] + ". " + initial(rng)
    elif rng.random() < 0.12:
        given += " " + (initial(rng) if rng.random() < 0.7 else made_given(rng))
    shape = rng.random()
    name = f"{family}, {given}" if shape < 0.18 else f"{family} {given}" if shape < 0.205 and len(given) > 2 else f"{given} {family}"
    case = rng.random()
    return name.upper() if case < 0.1 else name.lower() if case < 0.2 else family.upper().join(name.rsplit(family, 1)) if case < 0.24 else name


def plain_letters(text: str) -> str:
    import unicodedata

    return re.sub(r"[^a-z0-9]", "", unicodedata.normalize("NFKD", text.lower()))


def email(rng: random.Random, lang: str) -> str:
    f, g, n = plain_letters(made_family(rng)), plain_letters(made_given(rng)), str(rng.randrange(1000))
    local = rng.choice([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f + n, f + n, g + n, f"{g}.{f}{n}", f"{g[:1]}{f}", f"{f}.{g[:1]}", f"{f}_{g}", f"{f}.{g}", f"{f}-{g}", f"team.{f}", f"{rng.choice(NOUNS).lower()}.{f}", f"{g}.{f}+{made_word(rng).lower()}", "info", "office", "support", f"no-reply.{f}", "sales"])
    host = plain_letters(made_word(rng)) + rng.choice(["", "", "-" + plain_letters(made_word(rng, 1)), "." + plain_letters(made_word(rng, 1))]) + "." + rng.choice("com org net de fr es cn io edu co.uk info example test invalid local".split())
    at, dot = rng.choice([("@", ".")] * 7 + [("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" at ", " dot "), ("[at]", " dot "), ("(at)", " (dot) "), ("{at}", "{dot}"), (" @ ", "."), ("＠", "."), ("[at]", "."), (" AT ", " DOT "), ("(at)", "(punkt)")])
    if rng.random() < 0.5:
        text = local + at + host.replace(".", dot)
    else:
        text = (local + at + host).replace(".", dot) if dot != "." else local + at + host
    return text.upper() if rng.random() < 0.07 else text.title() if rng.random() < 0.08 else text


def digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def grouped(rng: random.Random, sizes: tuple[int, ...], separator: str | None = None) -> str:
    return (rng.choice([" ", "-", ".", " ", "", "/"]) if separator is None else separator).join(digits(rng, n) for n in sizes)


def phone(rng: random.Random, lang: str) -> str:
    d = lambda n: digits(rng, n)
    s = rng.choice([" ", "-", ".", " "])
    country = rng.choice([1, 31, 33, 34, 39, 41, 43, 44, 45, 46, 47, 48, 49, 55, 61, 81, 86, 91, 351, 353, 358, 420])
    plus = f"+{country}" if rng.random() < 0.75 else f"00{country}"
    national = grouped(rng, rng.choice([(3, 3, 4), (2, 4, 4), (3, 4, 4), (1, 2, 2, 2, 2), (3, 3, 3), (3, 2, 2, 2), (4, 6), (3, 7), (2, 5, 3), (3, 6), (4, 3, 3), (2, 8), (9,), (10,), (10,), (11,), (3, 6), (5, 3, 3), (4, 3, 3)]), rng.choice([" ", " ", "-", ".", ""]))
    area = rng.choice([2, 3, 4])
    return rng.choice(
        [f"{plus}{rng.choice([' ', ' ', '', '-'])}{national}", f"{plus} (0){national}", f"{plus} (0) {national}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"+1{rng.choice([' ', ' ', '-', ''])}{d(3)}{s}{d(3)}{s}{d(4)}", f"+1{d(10)}", f"+{country}{d(rng.randrange(8, 12))}"]
        + [f"0{d(area)}{rng.choice([' ', '/', '-', ' / '])}{grouped(rng, rng.choice([(5, 3), (6,), (7,), (3, 4), (4, 3), (2, 2, 2), (8,)]), rng.choice([' ', '-']))}", f"(0{d(area)}) {grouped(rng, rng.choice([(5, 3), (6,), (7,), (3, 4), (8,)]), rng.choice([' ', '-']))}", f"0{d(4)} {d(6)}", f"0{d(4)}-{d(3)}-{d(3)}", f"0{d(10)}"]
        + [s.join(["0" + d(1)] + [d(2) for _ in range(4)]), f"{rng.choice('5679')}{d(2)}{s}{d(3)}{s}{d(3)}", f"{rng.choice('679')}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"1{d(10)}", f"1{d(2)}{s}{d(4)}{s}{d(4)}", f"0{d(2)}-{d(8)}"]
    )


def idno(rng: random.Random, lang: str) -> str:
    d = lambda n: digits(rng, n)
    c = lambda n=1: "".join(rng.choice("ABCDEFGHJKLMNPRSTWXYZ") for _ in range(n))
    month = f"{rng.randrange(1, 13):02d}"
    local = {
        "en": [f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{c(2)} {d(2)} {d(2)} {d(2)} {rng.choice('ABCD')}", f"{c(2)}{d(6)}{rng.choice('ABCD')}"],
        "de": [f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), d(11), "0" + d(10), f"{d(2)} {d(6)} {c()} {d(3)}", f"{d(3)}/{d(4)}/{d(4)}"],
        "fr": [f"{rng.choice('12')} {d(2)} {month} {d(2)} {d(3)} {d(3)} {d(2)}", f"{rng.choice('12')}{d(2)}{month}{d(10)}", f"{rng.choice('12')}{d(2)}{month}{d(8)} {d(2)}"],
        "es": [f"{d(8)}{c()}", f"{d(8)}-{c()}", f"{rng.choice('XYZ')}{d(7)}{c()}", f"{rng.choice('XYZ')}-{d(7)}-{c()}", f"{d(8)} {c()}"],
        "zh": [f"{rng.choice('1234569')}{d(5)}{rng.choice(['19', '20', d(2)])}{d(2)}{month}{d(5)}{rng.choice('0123456789X')}"],
    }
    other = [f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(4)} {d(4)} {d(4)}", f"756.{d(4)}.{d(4)}.{d(2)}", f"{c(6)}{d(2)}{c()}{d(2)}{c()}{d(3)}{c()}", d(11)]
    roll = rng.random()
    text = rng.choice(local[lang] if roll < 0.7 else other if roll < 0.85 else local[rng.choice(list(local))])
    return text.lower() if rng.random() < 0.05 else text


def street(rng: random.Random, lang: str) -> str:
    name = rng.choice([made_word(rng), made_word(rng, 2), made_family(rng), rng.choice("Elm Oak Church Station Mill Park High Victoria Garden Bridge King Queen Castle Market School Rose Lake River Forest Linden Main".split())]) if lang == "en" else rng.choice([made_word(rng, 2), made_family(rng)])
    n, to = str(rng.randrange(1, rng.choice([60, 400, 2000]))), rng.random()
    number = n + (rng.choice(["a", "b", "c", " a", " b", "-" + str(int(n) + 2), "/" + str(rng.randrange(1, 20)), " – " + str(int(n) + 4)]) if to < 0.3 else "")
    if lang == "en":
        kind = rng.choice("Street Street Road Road Avenue Avenue Lane Close Court Drive Way Place Square Terrace Crescent Boulevard Gardens Grove Hill Row Mews Walk St. St. Rd Rd Ave Ave Dr Ln Blvd".split())
        front = rng.choice(["", "", "", "North ", "West ", "Old ", "New ", "Upper ", "Great ", "Saint "])
        text = f"{rng.choice([n, n, n + rng.choice('ABCabc'), n + '-' + str(int(n) + 2), n + ' ' + rng.choice('ab')])}{rng.choice([' ', ' ', ', '])}{front}{name} {kind}"
    elif lang == "de":
        ends = rng.choice("straße straße strasse str. gasse weg platz allee ring ufer damm markt anger".split())
        text = rng.choice([f"{name}{ends} {number}", f"{name}{rng.choice(['er', 'en', 'er'])} {ends.title()} {number}", f"{rng.choice(['Am', 'Im', 'Zum', 'Zur', 'An der', 'Auf der', 'Auf dem'])} {name}{rng.choice(['platz', 'anger', 'markt', 'ufer', 'ring', 'damm', 'weg', 'garten', 'berg', 'bach'])} {number}", f"{name}-{made_family(rng)}-{ends.title()} {number}"])
    elif lang == "fr":
        number = n + rng.choice(["", "", "", " bis", " ter", "bis", "-" + str(int(n) + 2), " B", "/" + str(int(n) + 2)])
        kind = rng.choice("rue rue rue avenue avenue boulevard place impasse allée chemin quai route cours passage av. bd square".split())
        text = f"{number}{rng.choice([' ', ' ', ', '])}{kind} {rng.choice(['', '', 'de ', 'du ', 'des ', 'de la ', 'de l’', 'd’', 'de l' + chr(39), 'Saint-'])}{name}"
    elif lang == "es":
        kind = rng.choice(["C/ ", "C/", "Calle ", "Calle ", "Calle de ", "Calle de la ", "Avda. ", "Av. ", "Avenida de ", "Avenida ", "Plaza ", "Plaza de la ", "Paseo de ", "Paseo del ", "Ronda ", "Camino de ", "Carrera ", "Travesía "])
        text = f"{kind}{name}{rng.choice([' ', ', ', ', ', ', n.º ', ' nº ', ', núm. ', ' n.º '])}{number}"
    else:
        text = "".join(rng.choice("建国中山人民解放和平新华长江文化青年东西南北京海湖滨花园金银龙凤朝阳") for _ in range(rng.choice((2, 2, 3)))) + rng.choice(["路", "街", "大街", "大道", "巷", "胡同", "东路", "西路", "中路"]) + f"{n}" + rng.choice(["", "", "-" + str(rng.randrange(1, 30))]) + rng.choice(["号", "号", " 号", "号之" + str(rng.randrange(1, 9))])
    case = rng.random()
    return text.upper() if case < 0.04 and lang != "de" else text.lower() if case < 0.08 else text


MAKERS = {"P": ("person", person), "E": ("email", email), "T": ("phone", phone), "I": ("idno", idno), "S": ("street", street)}


def other(rng: random.Random, slot: str) -> str:
    """A filler that is no mention."""
    n = rng.randrange(1, rng.choice([10, 100, 1000, 2500]))
    date = rng.choice([f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1990, 2040)}", f"{rng.randrange(1990, 2040)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(1, 29):02d}/{rng.randrange(1, 13):02d}/{rng.randrange(1990, 2040)}", f"{rng.choice('January March May July October December'.split())} {rng.randrange(1, 29)}"])
    match slot:
        case "G":
            return made_given(rng) if rng.random() < 0.85 else made_given(rng).lower()
        case "F":
            return made_family(rng)
        case "X":
            return made_word(rng) + (" " + made_word(rng) if rng.random() < 0.2 else "")
        case "A":
            if rng.random() < 0.1:
                return made_given(rng) + " " + rng.choice(NOUNS)
            first = rng.choice([made_word(rng), made_word(rng), made_family(rng), rng.choice(NOUNS), rng.choice("Blue Fast Happy Little Smart Urban Daily Open Super Clear".split())])
            return first + rng.choice([" ", " ", " ", " ", "", "-"]) + rng.choice(NOUNS if rng.random() < 0.5 else MADE_NOUNS if rng.random() < 0.9 else [made_word(rng)]) + rng.choice(["", "", "", f" {rng.randrange(1, 20)}", " Pro", " Lite", " Mini"])
        case "B":
            return rng.choice([made_given(rng), made_family(rng), made_word(rng)]) + " " + rng.choice("Sans Serif Mono Grotesk Display Script Slab Text Antiqua Gothic Condensed Neue Rounded".split()) + rng.choice(["", "", " Bold", " Light", " Italic", " Black", f" {n}", f", {n} pt"])
        case "Y":
            return rng.choice([made_given(rng), made_word(rng), made_word(rng), made_word(rng) + " " + made_word(rng, 1)]) + " " + rng.choice(["Mini", "Pro", "Max", "Tab", "Phone", "Pad", "Watch", "Fold", "Air", "Lite", str(n), "X" + str(n), "Tablet " + str(n), "S" + str(n)])
        case "N":
            return digits(rng, 3)
        case "C":
            return rng.choice(CITIES) if rng.random() < 0.8 else f"{digits(rng, 5)} {rng.choice(CITIES)}"
        case "n":
            return str(n)
        case "d":
            return rng.choice([digits(rng, rng.randrange(4, 14)), digits(rng, rng.randrange(8, 12)), f"{digits(rng, rng.randrange(4, 9))}-{digits(rng, rng.randrange(1, 4))}", grouped(rng, (2, 2, 2), " "), grouped(rng, (2, 2, 2, 2), " "), grouped(rng, (3, 3), "-"), "00" + digits(rng, rng.randrange(3, 10)), digits(rng, 11), f"{rng.choice('ABCXYZ')}{digits(rng, rng.randrange(5, 9))}"])
        case "D":
            return date + rng.choice(["", "", f" {rng.randrange(24):02d}:{rng.randrange(60):02d}", f"T{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"])
        case "V":
            return ".".join(str(rng.randrange(40)) for _ in range(rng.choice((2, 3, 4))))
        case "H":
            return f"{rng.getrandbits(rng.choice([32, 64, 128])):x}"
        case "K":
            return rng.choice("ABCDEFGHKLMNPQRSTUVWXYZ") * 1 + rng.choice(["", "-", rng.choice("ABCXYZ")]) + digits(rng, rng.randrange(1, 6))
        case _:
            return rng.choice([made_word(rng).lower() + rng.choice(["_" + digits(rng, 3), "", "-" + str(n), "@2x"]) + "." + rng.choice("png jpg pdf txt csv json".split()), f"https://{made_word(rng).lower()}.example/{made_word(rng).lower()}/{n}", f"{made_word(rng).lower()}@{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}", f"{made_word(rng).lower()}/{made_word(rng).lower()}@v{rng.randrange(9)}"])


#: what stands before a number to say what it is
BEFORE = {
    "T": {"en": "Tel|Tel.|Phone|phone|Mobile|Cell|Call|call|ring|text|hotline|help line|my line|switchboard|Fax|contact|dial|reach me on|number|WhatsApp|on", "de": "Tel|Tel.|Telefon|Mobil|Handy|Fax|Rückruf|Hotline|Nummer|Durchwahl|unter|Anruf|erreichbar unter", "fr": "tél|Tél.|téléphone|Portable|fax|numéro|appeler le|joindre au|au|Rappel", "es": "tel|Tel.|teléfono|Móvil|fax|número|llamar al|al|Contacto", "zh": "电话|手机|手机号|联系电话|拨打|热线|传真|座机"},
    "I": {"en": "SSN|ID|id|ID card|tax ID|TIN|national ID|NI number|NINO|identity card|identity number|social security number|tax number|passport no.|document", "de": "Steuer-ID|Steuer-Nr.|Steuernummer|IdNr.|Ausweis|Ausweisnummer|Personalausweis|SV-Nummer|Sozialversicherungsnummer|Identifikationsnummer|Kennnummer", "fr": "NIR|n° de sécu|sécurité sociale|numéro fiscal|SPI|carte d’identité|identifiant fiscal|INSEE|pièce d’identité|numéro", "es": "DNI|NIE|NIF|documento|identidad|documento de identidad|nº de identificación|número fiscal|carné", "zh": "身份证|身份证号|身份证号码|证件号|证件号码|税号|证件"},
    "E": {"en": "Email|E-mail|mail|mailto|contact|write to|reply to|from|via", "de": "E-Mail|Mail|Kontakt|an|von|schreiben an", "fr": "courriel|mél|e-mail|écrire à|contact|de", "es": "correo|e-mail|escribir a|contacto|de", "zh": "邮箱|邮件|电子邮箱|发到|联系"},
    "S": {"en": "Address|address|lives at|at|from|deliver to|location|on", "de": "Adresse|Anschrift|in der|wohnhaft|Lieferung an|Ort|Sitz", "fr": "adresse|habite|au|livrer au|siège|lieu|domicile", "es": "dirección|vive en|en|enviar a|domicilio|sede", "zh": "地址|住址|住在|位于|送到|寄到"},
    "P": {"en": "Name|by|from|contact|author|owner|chair|with|to|signed|Reviewer|Thanks|Dear|Hi", "de": "Name|von|Kontakt|Bearbeiter|Autor|mit|an|gez.|Prüferin|Danke|Hallo", "fr": "nom|par|de|contact|auteur|avec|à|signé|Merci|Bonjour", "es": "nombre|por|de|contacto|autor|con|a|firmado|Gracias|Hola", "zh": "姓名|由|来自|联系人|作者|老师|和|谢谢"},
    "B": {"en": "Font|font|Typeface|Font family|set in|Lettering|Headline", "de": "Schrift|Schriftart|Font|gesetzt in|Überschrift", "fr": "Police|Fonte|caractère|Titre", "es": "Fuente|Tipografía|letra|Título", "zh": "字体|字形|标题"},
    "Y": {"en": "Device|Phone|Model|on|Handset|Tablet|for", "de": "Gerät|Modell|Telefon|auf|mit", "fr": "Appareil|Modèle|Téléphone|sur", "es": "Dispositivo|Modelo|Teléfono|en", "zh": "设备|型号|手机|在"},
    "A": {"en": "App|Application|Program|in|opened|of|for|from", "de": "App|Programm|in|von|für", "fr": "Application|Appli|dans|de|pour", "es": "Aplicación|Programa|en|de|para", "zh": "应用|程序|在|从"},
    "d": {"en": "order|Order|invoice|ticket|locker|serial|build|job|run|page|item|code|total|seed|batch|record|version|step|row", "de": "Auftrag|Rechnung|Bestellung|Vorgang|Seite|Code|Summe|Schritt|Charge|Zeile|Posten", "fr": "commande|facture|dossier|page|code|total|étape|lot|ligne|article", "es": "pedido|factura|expediente|página|código|total|paso|lote|línea|artículo", "zh": "订单|发票|编号|页|代码|合计|步骤|批次|行"},
}


#: what people are called by their work
ROLES = {
    "en": "Nurse Plumber Judge Editor Farmer Sergeant Janitor Pilot Baker Senator Coach Translator Electrician Librarian Councillor Technician Trainee Supervisor Driver Student Witness Neighbour Clerk Gardener Cleaner Trainer Chef Composer Surveyor Caretaker Operator Secretary Treasurer Umpire".split(),
    "de": "Hausmeister Pflegerin Richter Bäckerin Lehrer Trainerin Fahrer Zeugin Nachbar Technikerin Sachbearbeiter Praktikantin Schülerin Übersetzer Gärtnerin Köchin Kassierer Elektriker Dolmetscherin Bürgermeister".split(),
    "fr": "Infirmière Plombier Juge Boulangère Professeur Entraîneur Chauffeur Témoin Voisine Technicien Stagiaire Étudiante Traducteur Jardinière Cuisinier Caissière Électricien Maire Gardienne Secrétaire".split(),
    "es": "Enfermera Fontanero Jueza Panadero Profesora Entrenador Chófer Testigo Vecina Técnico Becaria Estudiante Traductor Jardinera Cocinero Cajera Electricista Alcaldesa Conserje Secretaria".split(),
    "zh": "护士 医生 老师 司机 教练 律师 记者 校长 经理 工程师".split(),
}
DID = {
    "en": "agreed|left early|was late|has the key|signed it|sold the van|won|stayed at home|moved the chairs|paid in cash|sent a card|slept|knows the way".split("|"),
    "de": "hat unterschrieben|kommt später|fehlt heute|hat den Schlüssel|stellt die Stühle um|zahlt bar|hat gewonnen|bleibt zu Hause|kennt den Weg".split("|"),
    "fr": "a signé|arrive plus tard|est absent|a la clé|range les chaises|paie en espèces|a gagné|reste à la maison|connaît le chemin".split("|"),
    "es": "firmó|llega más tarde|falta hoy|tiene la llave|ordena las sillas|paga en efectivo|ganó|se queda en casa|conoce el camino".split("|"),
    "zh": "同意了|今天没来|签了字|有钥匙|赢了|在家休息|认识路".split("|"),
}


def acting(rng: random.Random, lang: str) -> str:
    """A sentence on what somebody did; half of them are of a given name, a family name, an application or a thing."""
    who = rng.choice(["{P}", "{P}", "{P}", "{G}", "{A}", "{X}", "{X} {n}"])
    role = rng.choice(ROLES[lang])
    if who in ("{P}", "{G}") and rng.random() < 0.5:
        who = role + (" " if lang != "zh" else "") + who if rng.random() < 0.8 else who + ", " + role.lower() + ","
    did = rng.choice(DID[lang])
    return (who + " " + did + rng.choice([".", "", "!", ";"])) if lang != "zh" else who + did + rng.choice(["。", "", "！"])


#: frequent small words, between which anything may stand
SMALL = {
    "en": "the a of to in and is was for on with that it at by from are as be this not or an but they we his her its our which after before when than into over under near some no all".split(),
    "de": "der die das und in zu den von mit ist auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum kann nur sein wir ihr".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ses aux l' d' n' s' qu' ou mais comme sans nous leur sous ces dont elle".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue".split(),
    "zh": "的 是 在 了 和 有 不 这 我 他 中 大 上 个 到 说 们 为 子 你 地 出 道 也 时 要 就 下 以 可 对 生 能 而 那 得 着 过 家 学 小 多 天 人 里 后 心 用 发 成 方 如 前 所 本 见 经 头 面 公 同 已 老 从 动 两 长".split(),
}
TAILS = {
    "en": "ed ing er ly tion ness ment s es al ous ive able".split(),
    "de": "en er ung lich keit heit te ten el es isch bar ig ungen".split(),
    "fr": "er ée ment tion eur euse é ant aient ique ette age s".split(),
    "es": "ar ado ción mente idad oso a os as ando ero illa ía".split(),
}


def salad(rng: random.Random, lang: str) -> str:
    """Made words between small ones, some with a capital, now and then a mention whose form alone shows what it is."""
    out = []
    for _ in range(rng.randrange(4, 14)):
        roll = rng.random()
        if lang != "zh" and out and not out[-1].islower():
            out.append(rng.choice(SMALL[lang]))  # no two capitals in a row
        elif lang == "zh":
            out.append(rng.choice(SMALL["zh"]) if roll < 0.6 else rng.choice(names.CHINESE_FAMILY + "图标页面字体按钮截屏尺寸系统程序功能边框位置颜色清楚问题版本账户支付列表") if roll < 0.85 else rng.choice(["{n}", "，", "。", "{X}", "{A}", "{d}"]))
        elif roll < 0.45:
            out.append(rng.choice(SMALL[lang]))
        elif roll < 0.75:
            word = made_word(rng, rng.choice((1, 1, 2)))
            out.append((word if rng.random() < (0.5 if lang == "de" else 0.15) else word.lower()) + rng.choice(TAILS[lang]))
        else:
            out.append(rng.choice(["{G}", "{X}", "{X}", "{A}", "{A}", "{A}", "{n}", "{n}", "{d}", "{d}", "{K}-{d}", "{K}", "{D}", "{W}", "{V}", "{T}", "{E}", "{I}", "{P}", "{S}"]))
    text = out[0]
    for word in out[1:]:
        text += word if lang == "zh" or text.endswith(("'", "’")) else rng.choice([" "] * 9 + [", ", ": "]) + word
    return text + rng.choice([".", "", "!", "?"])


def shows(slot: str, value: str) -> bool:
    """Whether the form of a mention shows what it is where nothing around it does."""
    if slot == "T":
        return not value.isdigit()
    return slot != "I" or not re.fullmatch(r"[\d ]+", value)


def labelled(rng: random.Random, lang: str) -> str:
    """A line of a mention or number with what it is called."""
    slot = rng.choice("TTTIIIESSPPPdddBYAA")
    name = rng.choice(BEFORE[slot][lang].split("|"))
    line = name + rng.choice([" ", " ", ": ", ":", " : ", ", ", " = ", " – "] if lang != "zh" else ["：", ":", "", "", " ", "是"]) + "{" + slot + "}"
    if slot == "T" and rng.random() < 0.3:
        line += rng.choice([" (ext. {n})", " ext {n}", ", extension {n}", " x{n}", " -{n} (fax)"] if lang != "zh" else ["转{n}", " (分机{n})"])
    return line + (rng.choice(["", "", ".", ",", " before {n} o'clock.", " ({n})", " please", " today", "!"]) if lang == "en" else rng.choice(["", "", ".", ","]) if lang != "zh" else rng.choice(["", "。", "，"]))


def signature(rng: random.Random) -> str:
    """What stands under a letter, on a card or in a row of a table."""
    parts = ["{P}", *rng.sample(["{S}", "{T}", "{E}", "{C}", "{S}", "{T}", "{E}", "{X}", "{D}", "{I}"], rng.randrange(1, 5))]
    if rng.random() < 0.3:
        rng.shuffle(parts)
    return rng.choice(["", "", "-- \n", "--\n", "— ", "\n"]) + rng.choice(["\n", "\n", " | ", ", ", " · ", " / ", "; ", "\t", " - "]).join(parts)


#: nouns of applications that no list of words has
MADE_NOUNS = [made_word(random.Random(n), 2) for n in range(40)]
_LINES = {lang: [line.replace("\\n", "\n") for line in block.strip().split("\n")] for lang, block in SENTENCES.items()}
_SLOT = re.compile(r"\{(\w)\}")


def text_of(rng: random.Random, lines: dict[str, list[str]] = _LINES) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]:
    """(text, mentions, listed): a text of a few sentences, its mentions (start, end, kind), of which some come again, and where names of known applications stand."""
    lang = rng.choice(["en", "en", "en", "de", "fr", "es", "zh"])
    known: dict[str, str] = {}
    text, spans, listed, curly = "", [], [], rng.random() < 0.5
    for _ in range(rng.randrange(1, 7)):
        form, shift = rng.random(), rng.random()
        line = labelled(rng, lang) if form < 0.2 else signature(rng) if form < 0.28 else acting(rng, lang) if form < 0.38 else salad(rng, lang) if form < 0.54 else rng.choice(lines[lang])
        parts = _SLOT.split(line)
        for i, part in enumerate(parts):
            if i % 2 == 0:
                part = part[1:] if part.startswith(".") and text.endswith(".") else part  # one point ends both
                part = part.replace("'", "’") if curly else part
                text += part.lower() if shift < 0.05 else part.upper() if shift < 0.09 else part
            elif part in MAKERS:
                kind, make = MAKERS[part]
                value = known[part] if part in known and rng.random() < 0.35 else make(rng, lang)
                while 0.38 <= form < 0.54 and not shows(part, value):
                    value = make(rng, lang)
                known[part] = value
                spans.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                value = other(rng, part)
                if part == "A" and rng.random() < 0.85:
                    listed.append((len(text), len(text) + len(value)))
                text += value
        text += rng.choice([" ", " ", "\n", "\n- ", "; ", " | ", "\n\n", " · ", ". "]) if lang != "zh" else rng.choice(["", "\n", " ", "。"])
    return text, spans, listed
