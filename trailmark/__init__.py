"""Product analytics on Spark: events, identity, sessions, funnels, journeys, attribution."""
