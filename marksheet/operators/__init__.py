"""DataFrame operators over checks, runs, events, trees and constraints."""
