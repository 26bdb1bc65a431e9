"""Questions labelled by hand: the template that answers them, or None where none does."""

ASKED = {
    "top_transactions": """
Mis olid minu kümme suurimat kulutust?
Näita kõige kallimaid oste eelmisel aastal
Kuhu läks kõige rohkem raha?
Milline oli suurim makse märtsis?
Too välja 5 kalleimat tehingut
Top 20 tehingut 2024-01-01 kuni 2024-06-30
Mis oli mu kõige odavam ost?
Leia väikseimad väljaminekud
Kõige suuremad arved sel aastal
Millele ma kõige rohkem kulutasin?
Suurimate ostude nimekiri
Kas saad öelda, mis oli kalleim asi, mille ostsin?
Järjesta tehingud summa järgi, suurimad ees
Anna mulle kulude edetabel
Mis oli mu suurim väljaminek eile?
Kõige väiksem makse üldse
Näita 15 odavaimat ostu
Kolm kõige kallimat tehingut juulis
Suured kulutused eelmises kvartalis
Milline ost oli kõige kulukam?
Missugune arve oli kõige suurem?
Kuva top 10 väljaminekut
Mis summad olid kõige kõrgemad?
Minu suurimad ülekanded detsembris
Millised on mu kõige väiksemad kulud?
Palun loetle rekordilised ostud
""",
    "recurring_payments": """
Millised korduvad maksed mul on?
Kellele läheb raha regulaarselt?
Näita minu püsimakseid
Mis tellimused mul praegu jooksevad?
Milliseid kuumakseid ma tasun?
Kas mul on igakuiseid makseid?
Millised arved korduvad iga kuu?
Mis läheb iga kuu kontolt maha?
Samale kaupmehele tehtud korduvad ostud
Regulaarsed väljaminekud 2023-01-01 kuni 2023-12-31
Millele olen abonemendi võtnud?
Leia kõik liikmemaksud
Kus ma käin korduvalt sama poes?
Näita püsikorraldusi ja tellimusi
Kellele maksan mitu korda aastas?
Milliseid teenuseid ma igakuiselt tellin?
Korduvad tehingud viimasel poolaastal
Kas mõni makse kordub regulaarselt?
Mis on minu fikseeritud igakuised kulud?
Loetle kõik perioodilised maksed
Kellele ma pidevalt raha kannan?
Mis voogedastuse tellimused mul on?
Näita kuutasusid
Millised on püsivad kohustused?
Iga kuu sama saaja ja makse
Kui palju kulub regulaarsetele arvetele?
""",
    "duplicate_payments": """
Kas olen midagi topelt maksnud?
On mõni arve makstud kaks korda?
Leia topeltmaksed
Näita dubleeritud tehinguid
Kas samal päeval on sama summa kaks korda läinud?
Kas pood võttis minult kahekordselt raha?
Kontrolli, ega ma pole sama arvet teist korda tasunud
Kahekordsed maksed 2024-01-01 kuni 2024-03-31
Kas on ekslikult topelt ülekandeid?
Sama saaja, sama summa, sama kuupäev
Kas mult on topelt raha võetud?
Otsi duplikaate tehingute seast
Kas üür läks kogemata kaks korda?
Milliseid makseid on tehtud topelt?
Kas kaardimakse läbis kaks korda?
Kas mõni tehing on kahekordne?
Näita samu summasid samal päeval
Kas ma maksin elektriarve topelt?
Kaks identset makset samale saajale
Leia kordusmaksed, mis on ekslikud
Kas kindlustus on kahekordselt tasutud?
Ega ma pole kellelegi teist korda kandnud?
Topeltarved eelmisel kuul
Kas on ühesuguseid tehinguid samal kuupäeval?
Kas telefoniarve võeti maha topelt?
Dubleerivad maksed palun
""",
    "frequent_small_payments": """
Kus ma sageli alla 15 euro kulutan?
Näita sagedasi väikeseid makseid
Kui palju läheb kohvikutesse?
Palju väikseid oste, kus need on?
Millised mikromaksed mul on?
Kus käin kioskis vähemalt 5 korda?
Pisikulud, mis kogunevad
Kus ma teen tihti väikseid oste alla 10 €?
Väikesed summad, mida kulutan sageli
Kuhu kaob mu peenraha?
Näksidele kuluv raha
Sagedased ostud kuni 5 eurot
Kus ostan tihti midagi väikest?
Väiksed kulutused kohvikus
Kui sageli ma kohvi ostan?
Mis pisimaksed korduvad vähemalt 10 korda?
Alla 3 euro maksed, mida on palju
Kas mul on palju väikeseid tehinguid?
Millistes poodides käin sageli väikse summa eest?
Tihedad väikeostud
Leia väikesed, aga sagedased kulud
Mikrotehingud alla 2 euro
Kohvikud ja kioskid eelmisel kuul
Kus kulutan sageli väikse summa?
Igapäevased pisikesed ostud
Väikemaksed kuni 20 eurot, vähemalt 8 korda
""",
    "price_rise": """
Mis teenus on läinud kallimaks?
Millised püsimaksed on tõusnud?
Kes tõstis hinda?
Näita hinnatõuse eelmisel aastal
Kas mõni tellimus on kallinenud?
Kus on hind kasvanud rohkem kui 10%?
Millise teenuse hind tõusis?
Kas internet läks kallimaks?
Püsikulud, mis on kasvanud
Milline kuutasu suurenes?
Leia hinnamuutused
Kelle arved on kallinenud üle 5 protsendi?
Kas telefonipakett kallines?
Teenusepakkujad, kes on hinda tõstnud
Hind kasvas 2023-01-01 kuni 2024-01-01
Kas püsimakse muutus suuremaks?
Millised hinnad kerkisid?
Kas spordiklubi tõstis kuutasu?
Kallimaks muutunud tellimused
Püsimakse hinnatõus vähemalt 20%
Kas mu elektripakett on nüüd kallim kui enne?
Mille hind on tõusnud kõige rohkem?
Kas kindlustusmakse suurenes?
Näita teenuseid, mille tasu on tõusnud
Hindade tõus minu tellimustes
Kas üürihind on kerkinud?
""",
    None: """
Milline on homne ilm?
Kes võitis eile jalgpalli?
Mis on minu konto saldo?
Kuidas avada uut pangakontot?
Mis on euro ja dollari kurss?
Kui suur on kodulaenu intress?
Tere, kuidas läheb?
Räägi üks nali
Mis kell on?
Kuidas vahetada PIN-koodi?
Kus asub lähim pangaautomaat?
Kirjuta luuletus kevadest
Mis on Eesti pealinn?
Kas saad soovitada head raamatut?
Kuidas teha pannkooke?
Palju on seitse korda kaheksa?
Millal on jaanipäev?
Kuidas taotleda krediitkaarti?
Mis on Bitcoini väärtus?
Kas aktsiad langevad?
Aita mul kirjutada kaaskirja
Kes on Eesti president?
Kui kaugel on Kuu?
Tõlgi see lause inglise keelde
Mis filme kinos näidatakse?
Kuidas blokeerida kadunud kaart?
Millal palk laekub?
Kas poed on pühapäeval lahti?
Soovita restorani Tallinnas
Mis on inflatsioon?
Kuidas investeerida fondidesse?
Anna nõu, kuidas säästa
Mis on minu krediidireiting?
Kuidas deklareerida tulumaksu?
Mitu elanikku on Tartus?
Kes kirjutas Tõe ja õiguse?
Kuidas ravida nohu?
Mis vahe on deebet- ja krediitkaardil?
Loo mulle treeningkava
Mida tähendab IBAN?
Kas homme sajab vihma?
Millal läheb viimane buss?
Kuidas parool taastada?
Mis on pensionifondi tootlus?
Kas sa oled inimene?
Kirjelda fotosünteesi
Kui palju maksab lennupilet Pariisi?
Milline telefon osta?
Mis on tähtajalise hoiuse intress?
Kuidas lõpetada leping pangaga?
Mitu sissetulekut mul oli?
Kes saatis mulle raha?
Kas mul on võlgu?
Milline on minu eelarve?
Arvuta ruutjuur sajast
Mis aastal Eesti iseseisvus?
Kas tomat on puuvili?
Mängi muusikat
Kustuta minu andmed
Muuda mu aadressi
Helista klienditeenindusse
Mis on panga lahtiolekuajad?
Milline on nädalapäev täna?
Kuidas õppida programmeerima?
Räägi mulle Saaremaast
Mis värvi on taevas?
Kas koer võib šokolaadi süüa?
Ütle parim spordiala
Kuidas pesta villast kampsunit?
Mis on elu mõte?
""",
}
QUESTIONS = [
    (text, template) for template, texts in ASKED.items() for text in texts.strip().split("\n")
]
