WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
