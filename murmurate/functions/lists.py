"""Word lists. Results depend on them as they stand."""

STOPWORDS = """
a an the and or but if then than that this these those is are was were be been being am do does did
doing have has had having i you he she it we they me him her them my your his its our their of in on
at to for with from by about as into like through after before between out up down off over under
again further once here there when where why how all any both each few more most other some such no
nor not only own same so too very can will just dont should now got get im it's rt http https new one
two make made way say says said people time day today what who dont cant wont thats theres
""".split()

MULTILINGUAL = """
que de la el los las una uno con por para pero como mas muy sin sobre este esta eso
nao sim uma dos das nos meu minha voce isso aqui ainda quando porque tambem
der die das und ist nicht ein eine auch noch aber wenn sich schon nur mit auf
les des une est pas plus dans pour que qui vous nous mais comme tout tres sur
non piu sono anche perche questo quando
""".split()

CONTRACTIONS = """
i'm don't it's can't won't didn't doesn't isn't aren't wasn't weren't haven't hasn't
hadn't wouldn't couldn't shouldn't you're they're we're i've you've we've they've
i'll you'll he's she's that's there's what's let's ain't y'all i'd you'd
""".split()

CALENDAR = """
mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday
saturday sunday jan feb mar apr jun jul aug sep sept oct nov dec january february
march april may june july august september october november december
am pm utc gmt est edt pst pdt today tomorrow yesterday
""".split()

#: No content as a single term.
EMPTY_WORDS = sorted({*STOPWORDS, *MULTILINGUAL, *CONTRACTIONS, *CALENDAR})
