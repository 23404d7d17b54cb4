"""Event, session and funnel-definition sources."""
