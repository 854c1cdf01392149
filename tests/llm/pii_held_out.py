"""Names and sentences for a test of the name finder; none of them stands in the training module."""

NAMES = {
    "en": "Emily Clark,Oliver Bennett,Charlotte Hughes,Benjamin Foster,Amelia Reed,Henry Coleman,Sophia Barnes,Nathan Hayes,Grace Sullivan,Ethan Brooks,Chloe Simmons,Samuel Pierce",
    "de": "Hannelore Vogt,Stefan Lorenz,Ingrid Schuster,Matthias Brandt,Heike Sommer,Rainer Pohl,Birgit Arnold,Dieter Haas,Anneliese Winkler,Uwe Seidel,Hiroshi Tanaka,Gudrun Ebert",
    "fr": "Camille Garnier,Cédric Chevalier,Manon Perrin,Julien Faure,Léa Rousseau,Antoine Blanchard,Océane Gauthier,Benoît Caron,Sylvie Marchand,Guillaume Renaud,Amadou Diallo,Solange Picard",
    "es": "Lucía Serrano,Pablo Castillo,Elena Vidal,Sergio Campos,Pilar Iglesias,Raúl Méndez,Nuria Cabrera,Alberto Fuentes,Inés Aguilar,Tomás Herrera,Ximena Quispe,Gonzalo Rivas",
    "zh": "陆小曼,周杰伦,林徽因,钱学森,孙悦然,黄晓明,赵丽颖,吴京,徐静蕾,郭晓东,何润东,高晓松,谢霆锋,韩雪,马伊琍",
}
SENTENCES = {
    "en": ("{N} opened the meeting at nine.", "The lease was signed by {N} yesterday evening.", "Could you find out whether {N} has read it?", "Person in charge: {N}", "Sincerely,\n{N}", "We are grateful to {N} and {M} for their comments.", "She introduced me to {N}, a teacher.", "In his reply, {N} denied it.", "The winner was {N}.", "If {N} agrees, we start."),
    "de": ("{N} eröffnete die Sitzung um neun.", "Den Vertrag hat {N} gestern Abend unterzeichnet.", "Wissen Sie, ob {N} es gelesen hat?", "Zuständig: {N}", "Hochachtungsvoll\n{N}", "Wir danken {N} und {M} für die Hinweise.", "Sie stellte mir {N} vor.", "In der Antwort bestritt {N} das.", "Gewonnen hat {N}.", "Wenn {N} zustimmt, geht es los."),
    "fr": ("{N} a ouvert la séance à neuf heures.", "Le bail a été signé par {N} hier soir.", "Savez-vous si {N} l'a lu ?", "Personne à joindre : {N}", "Salutations,\n{N}", "Nous remercions {N} et {M} pour leurs remarques.", "Elle m'a présenté {N}, un professeur.", "Dans sa réponse, {N} l'a nié.", "Le prix revient à {N}.", "Si {N} accepte, on commence."),
    "es": ("{N} abrió la reunión a las nueve.", "El contrato lo firmó {N} anoche.", "¿Sabes si {N} lo ha leído?", "Persona de contacto: {N}", "Saludos cordiales,\n{N}", "Damos las gracias a {N} y {M} por sus notas.", "Me presentó a {N}, un profesor.", "En su respuesta, {N} lo negó.", "Ganó {N}.", "Si {N} acepta, empezamos."),
    "zh": ("{N}在九点主持了会议。", "合同昨天由{N}签字。", "你知道{N}看过没有？", "联络人：{N}", "敬上\n{N}", "感谢{N}和{M}的意见。", "她把我介绍给{N}。", "在答复中，{N}否认了。", "获奖的是{N}。", "如果{N}同意，就开始。"),
}
NOBODY = {
    "en": "The Annual Report covers Northern Europe. Blue Harbor Holdings rents the hall in Cedar Rapids.", "de": "Der Jahresbericht der Nordlicht Holding liegt im Archiv Ost. Das Gerät Typ Omega steht in Bad Aibling.",
    "fr": "Le Rapport Annuel de la Banque Postale est paru. La salle est à Bourg-en-Bresse.", "es": "El Informe Anual del Banco Popular salió. La sala está en Puerto Real.", "zh": "年度报告由财务部门编写，方法和时间见附录。高速公路沿江而建，万一下雨请改道。",
}


def cases(lang):
    names = NAMES[lang].split(",")
    for i, name in enumerate(names):
        for sentence in SENTENCES[lang]:
            other = names[(i + 1) % len(names)]
            text = f"{NOBODY[lang]} " + sentence.replace("{N}", name).replace("{M}", other)
            yield text, {(text.index(name), "name")} | ({(text.index(other), "name")} if "{M}" in sentence else set())
