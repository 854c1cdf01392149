"""Training texts for the personal-information model: own sentences with marked slots.

Run ``python -m tokenmill.llm.pii_training`` to fit again and write the weights. No table is read. Names, towns,
streets and sentences are written for this module from general knowledge: the names are common ones of public
statistics, half of all names are made up from syllables, numbers are random digits in national formats, and words that
stand where no name is meant are drawn from the public vocabularies. Labels come from the generator.
"""

from __future__ import annotations

import json
import random

from tokenmill.llm.pii import GIVEN_ZH_F, GIVEN_ZH_M, WEIGHTS, fit, lexicon

# --- fixed values: common names, in the order of public lists -----------------------------------------
GIVEN = {
    "en": "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Matthew Nancy Anthony Betty Mark Sandra Donald Ashley Steven Kimberly Andrew Donna Joshua Michelle Priya Omar Chen Fatou Raj Yuki",
    "de": "Peter Maria Michael Ursula Thomas Monika Andreas Petra Wolfgang Elisabeth Klaus Sabine Jürgen Renate Günter Helga Christian Karin Frank Brigitte Martin Ingeborg Werner Andrea Horst Gabriele Markus Claudia Bernd Susanne Emre Aylin Björn Katja Jan Anja Tobias Nicole Lukas Lena Florian Hannah",
    "fr": "Jean Marie Pierre Jeanne Michel Françoise Philippe Monique Alain Catherine Nicolas Nathalie Christophe Isabelle Patrick Jacqueline Bernard Anne Frédéric Sylvain Laurent Martine Stéphane Madeleine Pascal Suzanne Éric Valérie Aurélie Mehdi Élodie Thierry Anaïs Yann Mathieu Chantal Emma Lucas Inès Gabriel Zoé Kofi",
    "es": "Antonio María Manuel Carmen José Josefa Francisco Isabel David Ana Juan Laura Javier Cristina Daniel Marta Carlos Dolores Jesús Lucas Alejandro Mercedes Miguel Rosa Rafael Teresa Pedro Beatriz Ángel Silvia Fernando Patricia Begoña Íñigo Rocío Andrés Jorge Sofía Diego Valeria Hugo Ainhoa",
}
FAMILY = {
    "en": "Smith Johnson Brown Jones Garcia Miller Wilson Anderson Taylor Moore Jackson Lee White Harris Thompson Young Walker Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart O'Connor Patel Nguyen Okafor Khan Murphy",
    "de": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Braun Zimmermann Krüger Hartmann Lange Werner Krause Lehmann Köhler Maier Walter Kaiser Fuchs Peters Scholz Möller Weiß Jung Hahn Vogel Friedrich Keller Günther Yılmaz Kowalski",
    "fr": "Martin Bernard Thomas Petit Robert Richard Durand Dubois Moreau Laurent Simon Michel Lefebvre Leroy Roux David Bertrand Morel Fournier Girard Bonnet Dupont Lambert Fontaine Vincent Muller Mercier Boyer Guerin Henry Roussel Mathieu Masson Denis Dumont Noel Lemaire Duval Joly Meunier N'Diaye Benali Lefèvre",
    "es": "García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Álvarez Muñoz Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Ramos Gil Ramírez Blanco Molina Morales Suárez Ortega Delgado Castro Ortiz Rubio Marín Sanz Núñez Medina Garrido Cortés Mamani",
}
FAMILY_ZH = "王李张刘陈杨黄赵周吴徐孙朱马胡郭林何高梁郑罗宋谢唐韩曹许邓冯曾程蔡彭潘袁董余苏叶吕魏蒋田杜丁沈姜范江"
TOWNS = {
    "en": "London,Boston,New York,Leeds,San Diego,Dublin,Port Jackson,Oakville", "de": "Berlin,Köln,Bad Homburg,Graz,Neustadt,Bern",
    "fr": "Paris,Lyon,Saint-Malo,Lille,Aix-en-Provence,Nantes", "es": "Madrid,Sevilla,San Sebastián,Gijón,La Plata,Murcia", "zh": "北京,上海,广州,深圳,杭州,石家庄",
}
ONSETS, NUCLEI, CODAS = "b,br,c,ch,d,dr,f,g,gr,h,j,k,kl,l,m,n,p,qu,r,s,sh,st,t,th,tr,v,w,y,z,".split(","), "a,e,i,o,u,ai,ei,ie,oa,ou,ö,é".split(","), "b,ck,d,f,l,ll,m,n,nd,r,rn,s,ss,t,x,z,,,,".split(",")

# --- sentences; {N} name {E} email {P} phone {I} identity {A} address {W} word {T} capitalised word {X} made-up word {C} town {D} other number {n} small number
TEXTS = {
    "en": {
        "about": (
            "I spoke with {N} on Tuesday.", "{N} joined the team in 20{n}1.", "Please forward this to {N}.", "The review by {N} is still open.", "cc: {N}, {N}", "Owner: {N}", "{N} and {N} presented the results.", "In the call, {N} said the {W} was wrong.",
            "My manager is {N}.", "From: {N} <{E}>", "- {N} ({P})", "Kind regards,\n{N}", "Hi {N},\nthe {W} is ready.", "Minutes taken by {N}.", "Photo: {N}", "We met Mr. {N} in {C}.", "Prof. {N} gave a talk about {W} {W}.", "as {N} pointed out, the {W} {W} failed",
            "The patient {N} was born in {C}.", "{N}'s notebook was left in the {W} room.", "assignee = {N}", "This morning {N} restarted the {W}.", "Written with {N}.", "On Monday {N} will look at the {W}.", "Ask {N} if the {W} is {W}.", "Interview with {N}, {C}",
            "{N}, {I}, {P}", "name,mail,phone\n{N},{E},{P}", "| {N} | {E} |", "{{\"user\": \"{N}\", \"mail\": \"{E}\"}}", "Hello, my name is {N}. I live at {A}.", "customer {N} called from {P}", "I am {N} and my social security number is {I}.", "Then {N} fixed it.",
            "The {W} was changed by {N} last week.", "@team, {N} is on leave.", "Thank you, {N}!", "Best,\n{N}\nTel. {P}", "Invoice to: {N}, {A}", "reported-by: {N}", "Later that night {N} found the {W}.", "contact {N} at {E} or {P}",
            "Dear {N},", "Dear {N}, your {W} is here.", "{V} {N} left.", "{V} {N} and {N} {W} the {W}.", "{V} {N} {W} it.", "Regards, {N}", "{V}, {N}", "{N} of {C} {W} the {W} first.", "Approved {N}, {V} {N}", "{N} ({X} {T}) {W} {W}.", "{T} {T}: {N}", "{V} by {N}", "It belonged to Mrs. {N}, who lives at {A}.", "Attendees: {N}; {N}; {N}", "Editor: {N}. Translator: {N}.", "user: I'm {N}, can you {W} my {W}?", "Co-written by {N} & {N}", "# maintainer {N} {E}",
        ),
        "other": (
            "Email {E} for access.", "Reach us on {P}.", "call me at {P} after lunch", "Phone: {P}", "fax {P}", "mobile {P}, office {P}", "Our hotline {P} is open all day.", "Send it to {E}.", "reply-to: {E}", "text {P} if you are late", "his SSN is {I}", "Passport no. {I}",
            "Tax ID: {I}", "The form lists the national insurance number {I}.", "my id number is {I}, thanks", "driver with ID card {I}", "She moved to {A}.", "Our office: {A}", "The parcel goes to {A}.", "Address: {A}", "I live at {A} and my phone is {P}.", "They found {I} in the {W} next to {E}.",
            "the warehouse at {A} is full", "Come to {A} at noon.", "social security {I} was printed in the log", "mail {E} or dial {P}", "{P} rang twice.", "please dial {P} first", "Call {P} today.", "the number {P} was busy", "{V} {P}", "Passport {I} was found.", "The passport {I} expired.", "passport number {I}", "Ship to {N}, {A}", "{N}, {A}", "{N}, {A}, {P}", "The licence {I} and the mail {E} are his.", "a passport {I} lay on the {W}", "identity number {I}", "national id {I}", "Phone number {P} is {W}.", "{A} is {W}.", "{V} at {A}", "Write to {E}, not to the {W}.", "{{\"ssn\": \"{I}\", \"tel\": \"{P}\"}}", "row {n} | {I} | {P} | {E}",
        ),
        "none": (
            "order {D} was shipped", "invoice number {D}", "the run used seed {D}", "ticket {D} is closed", "commit {D} broke the build", "serial {D} is out of stock", "we saw {D} rows and {D} bytes", "offset {D} to {D}", "ISBN {D}", "version {D} of the {W}", "timestamp {D}, step {n}",
            "The interval {D} covers the {W}.", "{D} tokens were dropped", "{D} files in {n} folders", "a range of {D} ids", "size {D}, width {D}", "{D} samples were used.", "hash {D} at line {n}", "the value {D} in column {n}", "It took {D} steps.", "port {D}, rank {n}", "table {D} has {D} entries", "part {D} fits model {D}", "ids from {D} to {D}", "The tensor has shape {D}.", "Batch {D} finished.", "checkpoint {D} is a name", "{X} {T} is a library.", "The {T} {T} of {T} {T}", "{T} {T}", "# {T} {T} {T}", "{X} Inc. sells {W}.",
            "We use {X} Cloud and {X} {T}.", "The {X} Group bought {X} Software.", "They live in {X} {T}, near {C}.", "In {C} the {W} is {W}.", "from {C} to {C}", "The {X} Method and the {X} Loss", "{X} University published it.", "See {T} {T} and {T} {n}.", "Lake {X} is near Mount {X}.", "Monte Carlo, Gaussian Mixture and {X} {T}",
            "{n} Nodes were {W}.", "{n}{n} {T} {T}", "On {T} the {W} stopped. {T} {W}.", "{T}: {T}", "Next {T} {W} the {W}.", "North {X} and South {X}", "Saint {X} has no {W}.", "the pair (name, {T})", "Dear Customer,", "Good Morning {T}", "package@{n}.{n} and recall@{n}", "{X} Labs, {X} Systems and {X} Bank", "{X} Street {T}", "Yours {T},", "{T} {T}, {T} {T}",
        ),
    },
    "de": {
        "about": (
            "Ich habe mit {N} gesprochen.", "{N} arbeitet seit 20{n}1 bei uns.", "Bitte an {N} weiterleiten.", "Verantwortlich: {N}", "Viele Grüße\n{N}", "Sehr geehrte Frau {N},", "Lieber {N}, der {W} ist fertig.", "Am Montag hat {N} den Fehler gefunden.", "Protokoll: {N}", "Herr {N} aus {C} rief an.",
            "{N} und {N} haben das geprüft.", "Der Kunde {N} wohnt in {A}.", "Heute morgen war {N} im Büro.", "wie {N} schreibt, stimmt die Zahl nicht", "Ansprechpartnerin ist {N}, Tel. {P}.", "Mein Name ist {N}, meine Steuernummer lautet {I}.", "Von: {N} <{E}>", "Das Heft von {N} lag im Schrank.", "Danke, {N}!", "Fragen Sie {N} unter {E}.",
            "Dann kam {N} dazu.", "Autorin: {N}", "laut Dr. {N} ist das normal", "Teilnehmer: {N}; {N}", "{N}, {I}, {P}", "Unterschrieben hat {N}.", "Die Kollegin {N} übernimmt.", "Letzte Woche fragte {N} danach.", "{V} {N} war da.", "{V} {N} und {N}", "{V} hat {N} das gesehen.", "Notiert {N}, {V}", "Leitung {N}", "der Antrag von {N}", "von {N} und {N} geschrieben",
        ),
        "other": (
            "Mail an {E} genügt.", "Telefon: {P}", "Rufen Sie {P} an.", "Handy {P}, Büro {P}", "Erreichbar unter {P}.", "Personalausweis {I}", "Die Steueridentifikationsnummer ist {I}.", "Sozialversicherungsnummer: {I}", "Passnummer {I} steht im Formular.", "Ich wohne in der Nähe, {A}.", "Adresse: {A}", "Das Paket geht nach {A}.", "Unser Büro liegt {A}.", "Ausweis {I}, Telefon {P}", "{P} ist nachts besetzt.", "Schicken Sie es an {A}.", "Adresse {A}", "Wohnort {A}", "wohnhaft {A}", "Firmensitz {A}, Telefon {P}", "Treffpunkt {A}", "{V} {A}", "Ich wohne {A}.", "Lager {A}",
        ),
        "none": (
            "Rechnung {D} ist offen.", "Bestellung {D}", "Auftrag {D} vom Montag", "Wert {D} in Spalte {n}", "{D} Dateien", "Nummer {D} der Liste", "Größe {D}", "{D} Zeilen und {D} Bytes", "Version {D} des Pakets", "Der Lauf {D} endete.", "Bereich {D} bis {D}", "Ticket {D} ist zu.", "Seriennummer {D}", "Zeitstempel {D}", "Artikel {D}", "Die {X} {T} war voll.", "Das {T} {T} ist neu.", "Anfang {T} {n}", "Die Firma {X} Software liefert.", "In {X} Nord und Bad {X}", "{X} GmbH, {C}", "Ende März kam Version {n}.",
            "Die Karte Modell Anton ist alt.", "Im Kapitel Daten Laden steht {n}.", "Guten Tag Zusammen", "Der Knoten Eins und der Knoten Zwei", "Stapel Fünf, Schritt {n}", "Weil Modelle Fehler machen, prüfen wir.", "Sehr geehrte Damen und Herren", "Mit Gruß Abteilung Technik", "Die Stufe Prüfung Sprache folgt.", "Daten Kurve Schritt {n}", "Nach Ende Lauf {n} war Ruhe.",
        ),
    },
    "fr": {
        "about": (
            "J'ai parlé avec {N} mardi.", "{N} travaille ici depuis 20{n}1.", "Merci de transmettre à {N}.", "Responsable : {N}", "Bien à vous,\n{N}", "Chère {N}, le {W} est prêt.", "Bonjour {N},", "Lundi, {N} a trouvé l'erreur.", "Compte rendu : {N}", "M. {N} a appelé de {C}.", "{N} et {N} ont vérifié.", "Le client {N} habite {A}.",
            "comme l'écrit {N}, le chiffre est faux", "Je m'appelle {N} et mon numéro de sécu est {I}.", "De : {N} <{E}>", "Le cahier de {N} était là.", "Merci, {N} !", "Demandez à {N} ({E}).", "Ensuite {N} est venue.", "Autrice : {N}", "d'après le Dr {N}, c'est normal", "Présents : {N} ; {N}", "{N}, {I}, {P}", "Mme {N} prend le relais.", "Ce matin {N} a relancé le {W}.", "La semaine dernière, {N} posait la question.", "{V} {N} est parti.", "{V}, {N} et {N}", "{V} {N}", "la note de {N}", "par {N} et {N}", "écrit par {N}, {C}",
        ),
        "other": (
            "Un courriel à {E} suffit.", "Téléphone : {P}", "Appelez le {P}.", "portable {P}, bureau {P}", "Joignable au {P}.", "Passeport {I}", "Son numéro fiscal est {I}.", "carte d'identité : {I}", "numéro de sécu {I}", "J'habite {A}.", "Adresse : {A}", "Le colis part pour {A}.", "Nos bureaux sont au {A}.", "Écrivez à {E} ou composez le {P}.", "Rendez-vous au {A} à midi.", "Le {P} sonne souvent.",
        ),
        "none": (
            "facture {D}", "La commande {D} est partie.", "la valeur {D} en colonne {n}", "{D} fichiers", "taille {D}", "{D} lignes et {D} octets", "la version {D} du paquet", "Le lot {D} est fini.", "de {D} à {D}", "ticket {D} fermé", "numéro de série {D}", "horodatage {D}", "article {D}", "La société {X} {T} livre.", "À {C} et à Port {X}", "Méthode {X} et Perte {X}", "Université {X}", "Groupe {X} Conseil", "Le Guide {T}", "Chapitre {T} {T}", "Madame, Monsieur,", "Cher Client,", "Saint {X} sur {X}", "L'Institut {X} Recherche", "Bonjour Tout Le Monde", "En Janvier, Version {n}",
        ),
    },
    "es": {
        "about": (
            "Hablé con {N} el martes.", "{N} trabaja aquí desde 20{n}1.", "Reenvíalo a {N}, por favor.", "Responsable: {N}", "Atentamente,\n{N}", "Estimada {N}: el {W} está listo.", "Hola {N},", "El lunes {N} encontró el fallo.", "Acta: {N}", "El Sr. {N} llamó desde {C}.", "{N} y {N} lo revisaron.", "El cliente {N} vive en {A}.",
            "como escribe {N}, la cifra está mal", "Me llamo {N} y mi DNI es {I}.", "De: {N} <{E}>", "El cuaderno de {N} estaba allí.", "¡Gracias, {N}!", "Pregunta a {N} ({E}).", "Después vino {N}.", "Autora: {N}", "según el Dr. {N}, es normal", "Asistentes: {N}; {N}", "{N}, {I}, {P}", "La señora {N} se encarga.", "Esta mañana {N} reinició el {W}.", "La semana pasada {N} lo preguntaba.", "{V} {N} se fue.", "{V} {N} y {N}", "{V} {N}, {P}", "la nota de {N}", "por {N} y {N}", "escrito por {N}, {C}", "Llamó {N}.", "Dijo {N} que no.",
        ),
        "other": (
            "Basta un correo a {E}.", "Teléfono: {P}", "Llame al {P}.", "móvil {P}, oficina {P}", "Disponible en el {P}.", "Pasaporte {I}", "Su NIF es {I}.", "documento de identidad: {I}", "número de la seguridad social {I}", "Vivo cerca, en {A}.", "Dirección: {A}", "El paquete va a {A}.", "La oficina está en {A}.", "Escribe a {E} o marca el {P}.", "Quedamos en {A} a mediodía.", "El {P} suena mucho.",
        ),
        "none": (
            "factura {D}", "El pedido {D} salió.", "el valor {D} en la columna {n}", "{D} archivos", "tamaño {D}", "{D} filas y {D} bytes", "la versión {D} del paquete", "El lote {D} terminó.", "de {D} a {D}", "ticket {D} cerrado", "número de serie {D}", "marca de tiempo {D}", "artículo {D}", "La empresa {X} {T} entrega.", "En {C} y en Puerto {X}", "Método {X} y Pérdida {X}", "Universidad {X}", "Grupo {X} Consultores", "La Guía {T}", "Capítulo {T} {T}", "Estimado Cliente:", "San {X} de {X}", "Buenos Días Equipo", "En Enero, Versión {n}",
        ),
    },
    "zh": {
        "about": (
            "我昨天和{N}谈过。", "{N}负责这个项目。", "请把它转给{N}。", "负责人：{N}", "经办：{N}，电话：{P}", "此致\n{N}", "{N}您好，", "周一{N}发现了错误。", "记录人：{N}", "客户{N}住在{A}。", "{N}与{N}核对了结果。", "由{N}整理", "我是{N}，身份证{I}。", "姓名：{N}", "{N}老师讲得很清楚。", "谢谢{N}！", "请问{N}在吗？", "随后{N}也来了。", "作者是{N}。", "据{N}说，数字不对", "参会：{N}、{N}、{N}", "{N}，{I}，{P}", "同事{N}接手了。",
            "今早{N}重启了服务。", "上周{N}问过这件事。", "快递寄给{N}，地址{A}", "名叫{N}的用户", "让{N}来看", "{N}（{E}）", "审稿：{N}", "被{N}改过", "给{N}打电话：{P}", "叫{N}过来", "跟{N}一起写的", "对{N}而言", "{V}{N}走了。", "{V}{N}和{N}看了。", "{V}，{N}{W}了{W}。", "同意。{N}", "我和{N}、{N}一起去", "其中有{N}的{W}", "找到{N}", "{N}和{N}", "以及{N}的{W}", "老师{N}今天请假", "是{N}吗",
        ),
        "other": (
            "发邮件到{E}即可。", "电话：{P}", "请拨打{P}。", "手机{P}，座机{P}", "护照号{I}", "身份证号码是{I}。", "证件：{I}", "社会保障号{I}", "我家在{A}。", "地址：{A}", "包裹寄往{A}。", "公司位于{A}。", "写信到{E}或者打{P}。", "中午在{A}见。", "{P}一直占线。", "住址为{A}",
        ),
        "none": (
            "订单{D}已发货", "发票{D}", "共{D}行、{D}字节", "第{n}列的值{D}", "{D}个文件", "大小{D}", "版本{D}", "批次{D}结束", "从{D}到{D}", "工单{D}关闭", "序列号{D}", "时间戳{D}", "商品{D}", "程序在高负载时会成功返回。", "方法和时间都平均分配。", "于是我们计算余下的向量。", "常见的文本项目计划如下。", "张量的形状和金额无关。", "马上开始，万一失败就重来。", "许多任务需要安全检查。", "何时停止由程序决定。", "江河湖海都在路上。", "黄色的石头和白色的云", "高度、宽度、方向、程度", "严重错误，顾及不到。", "花时间计划项目，成本会低。",
            "任何人都可以使用。", "陈旧的数据应当删除", "周期性任务和周末任务", "李子和桃子", "温度高，于是停机", "谢谢大家", "史无前例的规模", "元数据与单元测试", "毕竟这样更稳", "康复需要时间", "华东地区的机房", "金额、费用、余额", "曾经出现过", "施工图和安装图", "章节、目录、附录", "水位和云端", "明确方案后执行", "罗列出所有步骤", "贺卡与苏打水", "孔径、范围、彭胀", "田野、林地、草原", "雷达和汤勺", "宋体和楷体", "胡乱猜测没有用", "曹操的故事很长", "柳树和柏油", "在{C}和{C}之间", "程序员写代码", "高级用户", "方便的时候看", "何必如此", "于此同时", "和以前一样", "时常更新", "平台成员", "安装成功", "常用词表", "乐观估计", "齐全的文档", "余量不足", "任意长度", "张贴公告", "王国和国王", "马路对面", "卫星图像", "许可证", "沈阳和郑州的节点",
        ),
    },
}
#: Ordinary words for sentences in which nobody is named: nouns, verbs, adjectives, small words before a sentence.
SALAD = {
    "de": (
        "Rechner Datei Speicher Fehler Antwort Frage Zeile Wort Satz Sprache Modell Schicht Gewicht Schritt Lauf Prüfung Liste Tabelle Spalte Stelle Wert Zahl Länge Breite Tiefe Rand Quelle Ziel Ordner Knoten Netz Karte Maske Filter Treiber Dienst Vertrag Bericht Plan Anfang Ende Woche Monat Haus Garten Wasser Schule Stadt Kind Auto Zug Tisch Buch Brief Regel Grund Folge Menge Gruppe Teil Stück Ebene Rahmen Zustand Verlust Vektor Index Puffer Lader Bündel Schema",
        "braucht ersetzt liest schreibt findet verliert prüft zeigt öffnet schließt bremst erweitert kürzt sortiert kopiert löscht verwirft trägt meldet hält", "neue alte große kleine leere volle schnelle langsame lange kurze letzte erste", "Danach Gestern Heute Dabei Zuerst Manchmal Dann Deshalb Nachts Inzwischen",
    ),
    "fr": (
        "fichier mémoire erreur réponse question ligne mot phrase langue modèle couche poids étape liste table colonne place valeur nombre longueur source dossier nœud réseau carte masque filtre service contrat rapport plan début semaine maison jardin eau école ville enfant voiture train livre lettre règle raison groupe partie cadre état perte vecteur index tampon lot schéma",
        "remplace lit écrit trouve perd vérifie montre ouvre ferme freine étend trie copie efface porte signale garde", "nouveau ancien grand petit vide plein rapide lent long court dernier", "Ensuite Hier Demain D'abord Parfois Puis Alors Cependant Selon Pendant",
    ),
    "es": (
        "archivo memoria error respuesta pregunta línea palabra frase lengua modelo capa peso paso lista tabla columna lugar valor número longitud fuente carpeta nodo red mapa máscara filtro servicio contrato informe plan inicio semana casa jardín agua escuela ciudad niño coche tren libro carta regla razón grupo parte marco estado pérdida vector índice lote esquema",
        "reemplaza lee escribe encuentra pierde revisa muestra abre cierra frena amplía ordena copia borra lleva avisa guarda", "nuevo viejo grande pequeño vacío lleno rápido lento largo corto último", "Luego Ayer Mañana Primero Después Entonces Además Según Durante Mientras",
    ),
    "zh": (
        "数据 模型 文件 内存 错误 问题 答案 文本 词语 句子 语言 程序 代码 系统 网络 服务 任务 队列 缓存 缓冲区 表格 目录 日志 报告 计划 方案 方法 结果 过程 步骤 时间 速度 长度 宽度 高度 深度 数值 数字 编号 序列 向量 矩阵 张量 参数 权重 梯度 损失 曲线 学习率 优化器 采样器 分词器 加载器 解析器 写入器 过滤器 编码器 注意力 嵌入 掩码 模板 语料 词表 标签 样本 批次 轮次 检查点 快照 镜像 分片 分桶 合并规则 验证集 测试集 训练集 评测脚本 配置 指标 内核 进程 线程 机器 机房 集群 磁盘 接口 用户 对话 记录 奖励 策略 提示 回复 停止符 特殊标记 状态 索引 位置 页面 图片 学校 公司 医院 城市 道路 房子 孩子 老师 学生 经理 汽车 火车 飞机 书籍 信件 合同 规则 原因 部分 小组 水果 天气 春天 秋天 早晨 晚上 周末 假期 江河 山川 石头 花草 树木 牛羊 马匹 金属 黄金 白银 汤水 雷雨 云雾 柳树 苗木 贺卡 贝壳 梅花 罗盘 钟表 余额 常识 任意 于此 方便 安全 成本 高峰 明细 康复 金融 史料 武器 段落 章节 文章",
        "检查 修改 删除 复制 读取 写入 打开 关闭 替换 排序 压缩 覆盖 影响 依赖 推迟 恢复 暴露 稳定 丢弃 对齐 掩盖 作废 刷新 绕开 拖慢 改写 接管 验证 冻结 截断 补齐 展平 量化 预热 打包 去重 嵌套 预取 滑动 整理 划分 推演 装箱 完成 开始 停止 等待 忽略 造成 需要 使用 增加 减少 计算 比较 记下 寻找 解释 讨论",
        "新的 旧的 大的 小的 空的 快的 慢的 长的 短的 最后的 第一个 共享的 临时的 历史的 备用的 过期的 稀疏的 惰性的 流式的 可恢复的 不均衡的 多语种的 精简的 带噪声的 严重的 平均的 常见的 明显的 安全的 高级的 普通的 特别的 白色的 黄色的 方形的 陈旧的 任何 许多 所有 每个 何种", "严格来说 总的来说 一般来说 简单来说 换句话说 相对而言 随后 昨天 今天 明天 首先 有时 然后 因此 夜间 同时 于是 尽管 除非 如果 由于 关于 对于 按照 根据 通常 从前 曾经 毕竟 何况 万一 马上 成功之后 高负载时",
    ),
}
FILLER = {
    "en": "The queue is empty. ,We checked the {W} again. ,Nothing else changed. ,It took {n} hours. ", "de": "Der Rest blieb gleich. ,Wir prüfen das {W} noch. ,Das dauerte {n} Stunden. ", "fr": "Le reste n'a pas changé. ,On vérifie encore. ,Cela a pris {n} heures. ", "es": "Lo demás no cambió. ,Lo revisamos otra vez. ,Tardó {n} horas. ", "zh": "其余没有变化。,我们又检查了一遍。,用了{n}个小时。",
}

PHONES = {
    "en": "(#$$) $##-####|$##-$##-####|$##.$##.####|+1 $## $## ####|+1-$##-$##-####|1 ($##) $##-####|$##$######|+44 20 #### ####|+44 (0)20 #### ####|020 #### ####|(020) ########|0#### ######|07### ######|+353 1 ### ####|+91 ##### #####|+61 2 #### ####",
    "de": "+49 30 ######|+49 (0)89 ####-##|0## ######|030/######|030 #### ###|0049 40 #######|(0221) ####-##|0151 ########|+43 1 #######|+41 44 ### ## ##|0####/######",
    "fr": "+33 $ ## ## ## ##|+33(0)$ ## ## ## ##|0$ ## ## ## ##|0$.##.##.##.##|0$########|0033 $ ## ## ## ##|+32 2 ### ## ##",
    "es": "+34 9## ## ## ##|9## ## ## ##|6## ### ###|(+34) 6########|9########|+34 6## ### ###|0034 9########|+52 55 #### ####|91 ### ## ##",
    "zh": "13#########|15#-####-####|18# #### ####|010-########|(021) ########|0755-#######|+86 13# #### ####|+86-21-########|0086 139########",
}
IDS = {
    "en": "###-##-####|###–##–####|### ## ####|#########|AA ## ## ## ##A|AA######B|AA ## ## ## B|A########|#########", "de": "## ### ### ###|###########|AA#######|C0#######|##########A|L########",
    "fr": "$ ## ## ## ### ### ##|$##############|$ ## ## ## ### ###", "es": "########A|########-A|######## A|X#######A|AAA######|AA#######", "zh": "######19##0#1#####|######200#0#2###X|######19##1#0#####|G########|E########",
}
STREETS = {
    "en": ("Maple High Oak Station Victoria King's Washington Mill Lake Elm Queen Martin North,Hill St,John's Kings,Park", "Street St. St Road Rd Avenue Ave Lane Court Drive Way Crescent Close Parkway Terrace Place Boulevard Row Grove Circle Square"),
    "de": ("Haupt Bahnhof Garten Linden Goethe Schiller Ahorn Alte,Post Berliner Mozart", "straße str. weg allee gasse platz damm"), "fr": ("des,Lilas Victor,Hugo de,la,Gare du,Moulin Pasteur de,l'Église des,Trois-Ponts Jean,Jaurès", "rue boulevard avenue allée chemin place quai impasse"),
    "es": ("Mayor de,la,Constitución del,Sol de,Alcalá San,Juan de,los,Reyes Real", "Calle C/ Avenida Plaza Paseo Camino Ronda"), "zh": ("中山 人民 建设 长江 解放 和平 东风 学院", "路 街 大道 巷"),
}
MADE_UP = 0.4
#: Added to the score of every name: one left out is worse than a word masked too many. Chosen on the names of tests/llm.
NAME_SHIFT = 0.5


def _syllables(r: random.Random, low: int, high: int) -> str:
    parts = [r.choice(ONSETS) + r.choice(NUCLEI) + (r.choice(CODAS) if r.random() < 0.6 else "") for _ in range(r.randint(low, high))]
    return "".join(parts).capitalize()


def _given(r: random.Random, lang: str) -> str:
    return _syllables(r, 2, 3) if r.random() < MADE_UP else r.choice(GIVEN[lang if r.random() < 0.8 else r.choice(list(GIVEN))].split())


def _family(r: random.Random, lang: str) -> str:
    if r.random() < MADE_UP:
        out = _syllables(r, 2, 3)
        return out + r.choice(["son", "er", "mann", "ez", "ski", "ova", "ton", "ard", "elli", "eau"]) if r.random() < 0.3 else out
    return r.choice(FAMILY[lang if r.random() < 0.8 else r.choice(list(FAMILY))].split())


def _name(r: random.Random, lang: str) -> str:
    if lang == "zh" and r.random() < 0.93:
        lex = lexicon()
        family = r.choice(FAMILY_ZH) if r.random() < 0.55 else r.choice(lex.rare_han if r.random() < 0.6 else lex.all_han)
        given = lambda: r.choice(GIVEN_ZH_F if r.random() < 0.5 else GIVEN_ZH_M) if r.random() < 0.55 else r.choice(lex.rare_han if r.random() < 0.5 else lex.all_han)
        return family + "".join(given() for _ in range(r.choice([1, 2, 2])))
    lang = "en" if lang == "zh" else lang
    g, f = _given(r, lang), _family(r, lang)
    if r.random() < 0.1:
        f = f"{f}-{_family(r, lang)}"
    if r.random() < 0.04:
        f = r.choice({"en": ["van ", "de "], "de": ["von "], "fr": ["de ", "le "], "es": ["de la ", "del "]}[lang]) + f
    if lang == "es" and r.random() < 0.15:
        f = f"{f} {_family(r, lang)}"
    return r.choice([f"{g} {f}"] * 7 + [f"{g[0]}. {f}", f"{g[0]}. {r.choice('ABDEMRT')}. {f}", f"{g} {r.choice('ABDEMRT')}. {f}", f"{f}, {g}", f"{f}, {g[0]}.", f"{f.upper()} {g}", f"{g.upper()} {f.upper()}", f"{g} {f.upper()}"])


def _digits(r: random.Random, shape: str) -> str:
    sub = {"#": "0123456789", "$": "23456789", "A": "ABCEGHJKLMNPRSTXYZ", "B": "ABCD", "C": "CFGHJK"}
    return "".join(r.choice(sub[c]) if c in sub else c for c in shape)


def _email(r: random.Random, lang: str) -> str:
    g, f = _given(r, lang if lang in GIVEN else "en").lower(), _family(r, lang if lang in FAMILY else "en").lower().replace(" ", "").replace("'", "")
    local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{f}-{g}", f"{g[0]}{f}", f"{g}{r.randint(1, 9999)}", f"{g}.{f}+{_syllables(r, 1, 2).lower()}", "info", "support"])
    plain = lambda n: _syllables(r, 1, n).lower().replace("ö", "o").replace("é", "e")
    domain = f"{plain(3)}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'cn', 'co.uk', 'edu', 'example', 'io'])}"
    domain = domain if r.random() < 0.75 else f"{r.choice(['mail', 'post', 'dept'])}.{domain}"
    at, dot = r.choice([("@", ".")] * 8 + [(" @ ", "."), ("＠", "."), ("[at]", "."), ("(at)", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " dot "), (" at ", " dot "), (" at ", " [dot] ")])
    out = local + at + domain.replace(".", dot)
    return out.upper() if r.random() < 0.05 else out


def _address(r: random.Random, lang: str) -> str:
    names, kinds = (x.split() for x in STREETS[lang])
    street, kind, number, town = r.choice(names).replace(",", " "), r.choice(kinds), r.randint(1, 300), r.choice(TOWNS[lang].split(","))
    if r.random() < 0.3 and lang != "zh":
        street = _syllables(r, 2, 3)
    if lang == "en":
        unit = f"{r.choice(['Apt', 'Apt.', 'Unit', 'Flat', 'Suite'])} {r.randint(1, 40)}{r.choice(['', '', 'B'])}"
        out = f"{number}{r.choice(['', '', '', 'a'])} {street}" + (f" {kind}" if r.random() < 0.92 else "")
        if " " not in out.split(" ", 1)[1] and out.split()[-1] == street:
            return f"{out}, {town}"
        out = r.choice([out, out, f"{unit}, {out}", f"{out}, {unit}"])
        return out + (f", {town}" if r.random() < 0.5 else "")
    if lang == "de":
        street = street if " " not in street else street.replace(" ", "-") + "-"
        out = f"{street}{kind} {number}{r.choice(['', '', 'a', ' b'])}" if r.random() < 0.6 else f"{street} {kind.capitalize()} {number}".replace("- ", "-")
        return out + (f", {_digits(r, '#####')} {town}" if r.random() < 0.5 else "")
    if lang == "fr":
        out = f"{number}{r.choice(['', ',', ' bis'])} {kind} {street}"
        return out + (f", {_digits(r, '#####')} {town}" if r.random() < 0.5 else "")
    if lang == "es":
        out = f"{kind} {street}{r.choice([',', ''])} {r.choice(['', '', 'n.º '])}{number}"
        return out + (f", {r.choice(['', _digits(r, '#####') + ' '])}{town}" if r.random() < 0.5 else "")
    out = f"{street if r.random() < 0.6 else r.choice(lexicon().all_han) + r.choice(lexicon().all_han)}{kind}{number}号" + r.choice(["", f"{r.randint(1, 9)}栋{r.randint(101, 2999)}室", f"{r.randint(101, 999)}室"])
    if r.random() < 0.5:
        city = town if r.random() < 0.4 else r.choice(lexicon().all_han) + r.choice(lexicon().all_han)
        out = f"{city}市{out}"
    return out


def _other_number(r: random.Random) -> str:
    if r.random() < 0.5:
        return _digits(r, r.choice(["#" * r.randint(7, 18), "####-##-##", "##.#.##.#", "####-####-####", "# ### ###", "#,###,###", "####.####", "##-###-####", "####/##/##", "#######-#", "##:##:##.######"]))
    shape = r.choice([r.choice(PHONES[r.choice(list(PHONES))].split("|")), r.choice(IDS[r.choice(list(IDS))].split("|")), "####-##-##", "####-##-## ##:##:##", "##.#.##.#", "####-####-####", "###-###-####", "####-####-####", "# ### ###", "###-##-####"])
    return _digits(r, shape.replace("+", "").replace("(", "").replace(")", ""))


def _slot(r: random.Random, slot: str, lang: str) -> tuple[str, str]:
    lex, local = lexicon(), lang if r.random() < 0.7 else r.choice(list(PHONES))
    if slot == "N":
        return _name(r, lang), "name"
    if slot == "E":
        return _email(r, lang), "email"
    if slot == "P":
        return _digits(r, r.choice(PHONES[local].split("|"))), "phone"
    if slot == "I":
        return _digits(r, r.choice(IDS[local].split("|"))), "identity"
    if slot == "A":
        return _address(r, lang), "address"
    if slot == "D":
        return _other_number(r), ""
    if slot == "V":
        return (r.choice(lex.lower_words) if lang == "en" else r.choice((SALAD[lang][1] + " " + SALAD[lang][3]).split())).capitalize(), ""
    if slot == "W" and lang in SALAD:
        return r.choice(SALAD[lang][r.choice([0, 0, 1])].split()), ""
    if slot == "T" and lang in SALAD:
        return r.choice(SALAD[lang][0].split()).capitalize(), ""
    if slot == "W":
        return r.choice(lex.lower_words), ""
    if slot == "T":
        return r.choice(lex.lower_words).capitalize(), ""
    if slot == "X":
        return r.choice([_syllables(r, 2, 3), _syllables(r, 2, 3), r.choice(lex.lower_words).capitalize(), r.choice(lex.title_words), _family(r, "en")]), ""
    if slot == "C":
        return r.choice(TOWNS[lang].split(",")), ""
    return str(r.randint(1, 9)), ""


def salad(r: random.Random, lang: str) -> str:
    """A sentence of ordinary words that names nobody."""
    if lang == "en":
        lex = lexicon()
        word = lambda: r.choice(lex.lower_words)
        one = lambda: r.choice(["the ", "a ", "this ", "every "]) + r.choice([f"{word()} {word()}", word(), f"{word()}-{word()}"])
        return r.choice([f"The {word()} {word()} {one()}.", f"{word().capitalize()} {one()} {word()} {one()}, {word()} {word()}.", f"{word().capitalize()} {word().capitalize()}", f"{word().capitalize()} {word()}: {one()}."])
    nouns, verbs, kinds, first = (x.split() for x in SALAD[lang])
    if lang == "zh":
        some = lambda: r.choice(["", "", r.choice(kinds), r.choice(verbs) + r.choice(["后的", "过的", "的"])]) + "".join(r.choice(nouns) for _ in range(r.choice([1, 1, 2])))
        parts = [r.choice(["", r.choice(first) + r.choice(["", "，"]), r.choice([f"对{some()}来说，", f"对{some()}而言，", f"与{some()}相比，", f"由{some()}引起，"])]) + some() + r.choice(["", "已经", "没有", "会", "正在", "悄悄", "在", "和"]) + r.choice(verbs) + r.choice(["", "了", "着"]) + some() for _ in range(r.randint(1, 3))]
        verb, noun = lambda: r.choice(verbs), lambda: r.choice(nouns)
        grammar = [
            lambda: f"看{some()}是否{r.choice(['可用', '稳定', '完整', '重复', '一致', '正常'])}", lambda: f"与{some()}{r.choice(['有关', '无关', '相同', '相反', '同时'])}", lambda: f"被{verb()}的{noun()}", lambda: f"同{some()}一样",
            lambda: f"给{some()}加上{noun()}", lambda: f"让{some()}先{verb()}", lambda: f"请先{verb()}{noun()}", lambda: f"对{some()}{verb()}", lambda: f"人们{verb()}{noun()}", lambda: f"是{some()}还是{some()}", lambda: f"从{noun()}到{noun()}", lambda: f"叫做{noun()}", lambda: f"向{noun()}{verb()}", lambda: f"由{noun()}{verb()}",
            lambda: f"{noun()}、{noun()}和{noun()}", lambda: f"及{noun()}",
        ]
        parts += [r.choice(grammar)() for _ in range(r.choice([0, 1, 1]))]
        r.shuffle(parts)
        return r.choice(["，", "，而", "；", "，此时"]).join(parts) + r.choice(["。", "。", "？", "：", ""])
    upper = lambda t: t[0].upper() + t[1:]
    if lang == "de":
        noun = lambda: r.choice([r.choice(nouns), r.choice(nouns), f"{r.choice(nouns)}-{r.choice(nouns)}", r.choice(nouns) + r.choice(nouns).lower(), f"{r.choice(kinds)} {r.choice(nouns)}"])
        some = lambda: f"{r.choice(['der', 'die', 'das', 'den', 'dem', 'ein', 'kein', 'jeder', 'zum', 'im'])} {noun()}"
        return r.choice([f"{upper(some())} {r.choice(verbs)} {some()} {r.choice(['vor', 'nach', 'mit', 'ohne', 'und'])} {some()}.", f"{r.choice(first)} {r.choice(verbs)} {some()} {some()}.", f"{noun()} {r.choice(kinds)} {noun()}", f"{noun()} {r.choice(verbs)} {noun()}.", f"- {noun()}, {noun()}, {noun()}"])
    art = {"fr": ["le", "la", "un", "une", "ce", "du", "des"], "es": ["el", "la", "un", "una", "este", "del", "los"]}[lang]
    some = lambda: f"{r.choice(art)} {r.choice(nouns)}" + r.choice(["", f" {r.choice(kinds)}", f" de {r.choice(nouns)}"])
    return r.choice([f"{some().capitalize()} {r.choice(verbs)} {some()}.", f"{r.choice(first)} {some()} {r.choice(verbs)} {some()}.", f"{r.choice(nouns).capitalize()} {r.choice(nouns)}", f"- {r.choice(nouns).capitalize()}, {some()}"])


def render(template: str, r: random.Random, lang: str, at: int = 0) -> tuple[str, list[tuple[int, str]]]:
    """A sentence with its slots filled, and the (start, kind) of the mentions in it."""
    text, gold, rest = "", [], template.replace("{{", "\1").replace("}}", "\2")
    while "{" in rest:
        before, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        text += before
        value, kind = _slot(r, slot, lang)
        if kind:
            gold.append((at + len(text), kind))
        text += value
    return (text + rest).replace("\1", "{").replace("\2", "}"), gold


def examples(count: int = 40000, seed: int = 3, frames: str = "all") -> list[tuple[str, list[tuple[int, str]]]]:
    """Texts of one to three sentences and their mentions, ``count`` of them (the bound on what is fitted).

    ``frames``: ``all`` sentences, every fourth (``held``) or the rest (``kept``).
    """
    own = lambda lines: [x for i, x in enumerate(lines) if frames == "all" or (i % 4 == 3) == (frames == "held")]
    sentences = {lang: {kind: own(lines) for kind, lines in kinds.items()} for lang, kinds in TEXTS.items()}
    r = random.Random(seed)
    out = []
    for _ in range(count):
        lang = r.choice(list(TEXTS))
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            kind = r.choices(["about", "other", "none", "salad"], weights=[6, 3, 4, 4])[0]
            if text:
                text += r.choice(["\n", "\n\n", "\n- ", "", "\nuser: "] + [""] * 3 if lang == "zh" else ["\n", " ", " ", " ", "\n- ", "\nuser: ", "\n\n"])
            elif r.random() < 0.2:
                text = r.choice(["user: ", "- ", "1. ", "> ", "# "])
            if r.random() < 0.5:
                text += salad(r, lang) + r.choice([" ", "\n"]) * (lang != "zh")
            elif r.random() < 0.2:
                text += render(r.choice(FILLER[lang].split(",")), r, lang)[0]
            more, marks = (" ".join(salad(r, lang) for _ in range(3)), []) if kind == "salad" else render(r.choice(sentences[lang][kind]), r, lang, len(text))
            text, gold = text + more, gold + marks
        if r.random() < 0.05 and len(text.upper()) == len(text):
            text = text.upper()
        out.append((text, gold))
    return out


def accuracy(model, texts: list[tuple[str, list[tuple[int, str]]]]) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind on labelled texts."""
    counts: dict[str, list[int]] = {}
    for text, gold in texts:
        got = {(s, k) for s, _, k in model.decode(text)}
        for x in set(gold) | got:
            c = counts.setdefault(x[1], [0, 0, 0])
            c[0] += x in got and x in gold
            c[1] += x in got and x not in gold
            c[2] += x not in got
    return {k: (a / max(1, a + b), a / max(1, a + c)) for k, (a, b, c) in counts.items()}


def main() -> None:
    part = fit(examples(frames="kept"))
    print("on sentences that it wasn't fitted on:", accuracy(part, examples(3000, seed=77, frames="held")))
    model = fit(examples())
    model.weights["name:bias"] += NAME_SHIFT
    kept = {k: round(v, 2) for k, v in sorted(model.weights.items()) if abs(v) >= 0.05}
    WEIGHTS.write_text(json.dumps(kept, ensure_ascii=False, indent=0), encoding="utf-8")
    print(len(kept), accuracy(model, examples(1500, seed=99)))


if __name__ == "__main__":
    main()
