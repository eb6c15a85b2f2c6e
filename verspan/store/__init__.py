"""Tables kept between runs: parts with a registry, the search index, side indexes, resource runs."""
