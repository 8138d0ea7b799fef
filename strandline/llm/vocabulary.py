"""The vocabulary of the URL filter: the one source of its code and of its SQL.

Strict terms reject a url alone; soft ones by the weights of distinct terms found.
All are lower-case ASCII; a term may hold what stands between words of a url.
"""

from __future__ import annotations

STRICT = tuple(
    """
casino casinos porn porno pornhub xxx viagra cialis malware phishing warez escort escorts spam-farm ads-track keylogger torrent torrents
adultfriend bdsm blowjob camgirl camgirls camsex cumshot deepthroat dildo erotica fetish gangbang hardcore-sex hentai hookup-now incest jizz
livecams livesex milf naked-girls nude-girls nudes orgy pornstar pornstars redtube sex-chat sexcam sexcams sexshop sextape striptease swingers
threesome upskirt voyeur webcam-girls x-rated xhamster xnxx xvideos youporn
baccarat blackjack-online bookmaker bookmakers craps-online gambling jackpot-city live-casino online-betting online-casino online-slots
poker-online roulette slot-machine slot-machines slots-online sportsbook sportwetten spielautomaten casino-en-ligne apuestas-online
botnet carding cc-dumps clickjacking cryptojacking cvv-shop ddos-for-hire exploit-kit fake-id fake-ids fake-passport fullz hacked-accounts
infostealer keygen keygens malvertising nulled ransomware rat-builder rootkit serial-key serialz spyware stealer-logs stresser trojan
account-verify-login confirm-your-account secure-login-update update-billing verify-your-account wallet-connect-validate
0day appz cracked-software crackz dvdrip-download fullcrack gamez-iso moviez mp3-download-free pirated piratebay rarbg romz scene-release
tvrip warezz yify
buy-ambien buy-oxycodone buy-tramadol buy-xanax cheap-meds generic-viagra kamagra levitra no-prescription online-pharmacy
penis-enlargement pharmacy-online phentermine steroids-online valium-online xanax-online
backlink-farm doorway-page link-farm linkfarm parked-domain pbn-network private-blog-network scraper-site seo-spam splog spamdexing
made-up-news pump-and-dump binary-options-signals get-rich-quick hyip ponzi
""".split()
)

SOFT = {
    term: float(weight)
    for term, weight in (
        line.split()
        for line in """
ads 1
adserver 1
adclick 1
adsense 0.5
advert 0.5
affiliate 0.5
aff_id 0.5
track 1
tracker 1
tracking 0.5
spam 1
win 1
winner 0.5
farm 0.5
bet 1
bets 1
betting 1
wager 1
poker 1
blackjack 1
bingo 1
lotto 1
lottery 1
jackpot 1
slots 1
loan 1
loans 1
payday 1
credit-repair 1
debt-relief 1
forex 0.5
bitcoin-doubler 1.5
airdrop 0.5
giveaway 0.5
adult 1
sex 1
sexy 1
nude 1
naked 1
erotic 1
hot-girls 1.5
singles 0.5
dating 0.5
hookup 1
webcam 0.5
cams 0.5
18plus 1
free 0.5
bonus 1
coupon 0.25
coupons 0.25
discount 0.25
cheap 0.5
deal 0.25
deals 0.25
offer 0.25
promo 0.25
replica 1
rolex 1
outlet 0.25
pills 1
pill 1
pharmacy 0.5
meds 0.5
diet 0.25
weight-loss 0.5
keto 0.5
cbd 0.5
vape 0.5
crack 1
cracked 1
hack 1
hacks 1
cheats 0.5
serial 0.5
activator 1
patch 0.25
mod-apk 1
apk 0.25
iso 0.25
rip 0.25
click 0.5
clicks 0.5
redirect 0.5
redir 0.5
popunder 1.5
popup 0.5
doorway 1
parked 0.5
landing 0.25
lp 0.25
gclid 0.25
fbclid 0.25
utm_source 0.25
utm_medium 0.25
utm_campaign 0.25
sessionid 0.5
phpsessid 0.5
jsessionid 0.5
signup-now 0.5
subscribe-now 0.5
earn-money 1
make-money 1
work-from-home 0.5
mlm 0.5
clickbait 1
shocking 0.5
viral 0.25
leaked 0.5
unblocked 0.5
proxy-list 1
vpn-free 0.5
essay-writing 0.5
buy-followers 1.5
buy-likes 1.5
backlinks 1
seo-services 0.5
""".strip().splitlines()
    )
}
LIMIT = 2.0
